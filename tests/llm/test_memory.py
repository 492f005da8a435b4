"""What a worker holds: the encoder's arrays and tables are bounded, tasks of another kind find it gone."""

import tracemalloc
import weakref

import pyarrow as pa

from cloakwork.llm import common, pfair, tokens
from cloakwork.llm.common import table

SF = "/root/testdata/sf0.001"


def test_ids_are_laid_out_in_blocks():
    encode = tokens.Encoder(tokens.default_tokenizer())
    batch = pa.array([f"{i} " + "one two three " * 5000 for i in range(64)])  # a million units
    encode.many(batch.slice(0, 1))
    tracemalloc.start()
    got = encode.many(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    assert [got[i].tolist() for i in (0, 63)] == [encode.library.encode(batch[i].as_py(), add_special_tokens=False).ids for i in (0, 63)]


def test_long_units_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 20, raising=False)
    encode = tokens.Encoder(tokens.default_tokenizer())
    before = pa.total_allocated_bytes()
    for i in range(40):
        text = f"{i} " + f"abc{i}xyz" * 15_000
        assert encode(text).tolist() == encode.library.encode(text, add_special_tokens=False).ids
    assert pa.total_allocated_bytes() - before < 2 << 20


def test_units_are_found_in_every_table(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_UNITS", 50, raising=False)
    monkeypatch.setattr(tokens, "UNITS_AT_ONCE", 7, raising=False)
    encode = tokens.Encoder(tokens.default_tokenizer())
    texts = [" ".join(f"w{(i * j) % 97}\nx{i}" for j in range(30)) for i in range(20)] + ["", " ", "a", "\n", "ends ", "漢字 whole", "a  b"]
    for batch in (texts[:9], texts, texts[::-1], ["漢字"], [""], []):
        got = encode.many(pa.array(batch, pa.string()))
        assert [x.tolist() for x in got] == [encode.library.encode(t, add_special_tokens=False).ids for t in batch]
    assert len(encode.tables) > 1


def test_other_tasks_find_the_encoder_gone():
    made = []

    def one(batches):
        made.append(weakref.ref(tokens.encoder(tokens.default_tokenizer())))
        yield from batches

    def other(batches):
        yield from batches

    for _ in range(2):
        list(common._run(one, (), iter([])))
    assert made[0]() is made[1]() is not None
    list(common._run(other, (), iter([])))
    assert made[0]() is None


def test_mixing_starts_no_python_workers(spark, monkeypatch):
    seen, real = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: seen.append(real(self, *a, **k)) or seen[-1])
    pfair.schedule(table(spark, SF, "documents"))
    says = lambda df: df._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" in says(real(spark, [("a", 1)], "k string, n long"))
    assert seen and not any("PythonRDD" in says(df) for df in seen)
