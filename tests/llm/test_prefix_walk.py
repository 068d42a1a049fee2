"""The prefix program of token counts against the library, and how often it asks the vocabulary."""

import random

import public_tokenizers

from folio.llm import bpe


class Asked(dict):
    n = 0

    def get(self, key, default=None):
        self.n += 1
        return super().get(key, default)


def test_op10_asks_the_vocabulary_at_most_once_a_prefix():
    """Tokens that end a prefix are found by walking back from its end, not by a look-up for each of its ends."""
    c = bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    c.ranks = Asked(c.ranks)
    r = random.Random(10)
    parts = ["th", "ing", "er", "on", "q", "zx", "é", "ü", "ß", "ation", "st", "日"]
    for _ in range(300):
        word = " " + "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        piece = c.pieces(word)[0]
        before = c.ranks.n
        counts = bpe.prefix_counts(c.piece_table(piece)).tolist()
        assert c.ranks.n - before <= len(piece.encode())
        assert counts == [len(c.library.encode(piece[: i + 1], add_special_tokens=False).ids) for i in range(len(piece))]
