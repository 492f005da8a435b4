"""The encoder asks the library once for each piece; its cuts and the planes' order are the library's and brute force's."""

import random

import numpy as np
import pyarrow as pa

from cloakwork.llm import tokens, wavelet


class Counting:
    """The library with the signs counted that it is given."""

    def __init__(self, library):
        self.library, self.signs = library, 0

    def __getattr__(self, name):
        real = getattr(self.library, name)
        return Counting.of(self, real) if callable(real) and name.startswith(("encode", "tokenize")) else real

    def of(self, real):
        def call(given, *args, **options):
            self.signs += sum(map(len, given)) if isinstance(given, list) else len(given)
            return real(given, *args, **options)

        return call

    @property
    def model(self):
        outer = self

        class Model:
            tokenize = staticmethod(outer.of(outer.library.model.tokenize))

        return Model


def test_each_piece_is_merged_once():
    rng = random.Random(3)
    words = list({"".join(rng.choices("abcdefghij", k=12)) for _ in range(2000)})
    text = " ".join(w + mark for mark in ("", ".", ",", "!!", "...", "&&&") for w in words)
    encode = tokens.Encoder(tokens.default_tokenizer())
    want, encode.library = encode.library.encode(text, add_special_tokens=False).ids, Counting(encode.library)
    assert encode(text).tolist() == want
    assert encode.library.signs < 1.5 * sum(map(len, words))


def test_pieces_are_the_librarys():
    encode = tokens.Encoder(tokens.default_tokenizer())
    signs, rng = tokens._PLAIN, random.Random(4)
    texts = [a.format(c) for c in signs for a in ("{}", " {}", "{} ", "\n{}", "{}\n", "x{}y", "1{}2", ".{}.", "'{}", "a'{}b", " '{}")]
    for pool in (signs, list(" \n'sdmtlvre.,"), list("aé1²'s _-.ª·ßIŉ"), ["don't", "we'll", "'ve", "I'RE", " ", "12", "...", "\n", "''s", "€", "\x00", "\x01", "Ā"]):
        texts += ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(500)]
    want = [e.ids for e in encode.library.encode_batch(texts, add_special_tokens=False)]
    for apart in (encode.apart, None):  # merged in groups, merged one by one
        encode._empty()
        encode.apart = apart
        assert [x.tolist() for x in encode.many(pa.array(texts))] == want


def test_planes_are_sorted_in_steps(monkeypatch):
    monkeypatch.setattr(wavelet, "STEP", 64, raising=False)
    for n in (0, 1, 63, 64, 65, 1000):
        for most in (1, 2, 50_257, 1 << 20):
            ids = np.random.default_rng(n).integers(0, most, n)
            planes = wavelet.decode_file(wavelet.encode(ids, [(1, n)]))[0]
            assert planes.decode().tolist() == ids.tolist()
            assert [planes.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
