"""Held-out quality of the learned operators, and the mixing schedule's guarantees."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import importance, pfair, rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2))
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.filter(fold == 0).collect()}
    return docs, labels.filter(fold == 1), truth


def split(kept, truth):
    good, bad = [i for i, (q, _) in truth.items() if q == 1], [i for i, (q, _) in truth.items() if q == 0]
    return sum(kept[i] for i in good) / len(good), sum(not kept[i] for i in bad) / len(bad)


def test_importance(labelled):
    docs, labels, truth = labelled
    got = importance.classify(docs, labels).collect()
    good, bad = split({r.doc_id: r.kept for r in got}, truth)
    assert good > 0.97 and bad > 0.9
    assert len(got) == docs.count()
    again = importance.classify(docs.repartition(7), labels).select("doc_id", "kept").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.kept) for r in got)
    ids = sorted(r.doc_id for r in importance.keep_drawn(docs, labels).collect())
    assert ids == sorted(r.doc_id for r in got if r.kept)


def test_importance_top_k(labelled):
    docs, labels, _ = labelled
    rows = importance.classify(docs, labels, importance.Settings(keep=100)).collect()
    top = sorted((r.draw_key for r in rows if r.n_features), reverse=True)[:100]
    assert sorted(r.draw_key for r in rows if r.kept) == sorted(top)


def test_importance_odd_rows(spark, labelled):
    docs, labels, _ = labelled
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "some words here"), (-4, "word " * 50_000), (-5, "twin row"), (-5, "twin row")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd).withColumns({"quality": F.lit("clash"), "n": F.lit(1), "label_id": F.lit(2)})
    got = importance.classify(rows, labels).filter("doc_id < 0 or doc_id is null").collect()
    assert len(got) == 6 and not any(r.kept for r in got if r.doc_id in (-1, -2))
    kept = importance.keep_drawn(rows, labels)
    assert kept.columns == rows.columns and kept.filter("doc_id in (-1, -2)").count() == 0
    assert importance.classify(docs.limit(0), labels).count() == 0
    assert importance.classify(docs.limit(20), labels.limit(0)).filter("kept").count() == 20


def test_importance_rejects_toxic(labelled):
    docs, labels, truth = labelled
    kept = {r.doc_id: r.kept for r in importance.classify(docs, labels, importance.Settings(reject_toxic=True)).collect()}
    toxic, clean = [i for i, (q, t) in truth.items() if q == t == 1], [i for i, (q, t) in truth.items() if q == 1 and t == 0]
    assert sum(not kept[i] for i in toxic) / len(toxic) > 0.5
    assert sum(kept[i] for i in clean) / len(clean) > 0.97


def test_rules(labelled):
    docs, labels, truth = labelled
    got = rules.judge(docs, labels).collect()
    good, bad = split({r.doc_id: r.kept for r in got}, truth)
    assert good > 0.97 and bad > 0.9
    assert {r.kept for r in got if r.base_failed} <= {False}


def test_schedule_is_pfair(spark):
    rows = [(i, s) for s, n in (("a", 900), ("b", 300), ("c", 77), (None, 40), ("e", 1)) for i in range(len(s or "") + 10_000 * ord((s or "z")[0]), len(s or "") + 10_000 * ord((s or "z")[0]) + n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"count": F.lit("clash"), "k": F.lit(1), "text": F.lit("t")})
    s = pfair.Settings(block=4, period=64, slice_rows=50)
    got = pfair.schedule(df, s).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    slots, blocks = defaultdict(set), Counter()
    for r in got:
        slots[r.mix_slot].add((r.source, r.mix_block))
        blocks[r.source, r.mix_block] += 1
        assert r.mix_release <= r.mix_slot < r.mix_deadline and 0 <= r.mix_rank < 4
    assert all(len(x) == 1 for x in slots.values()) and max(blocks.values()) == 4
    assert len({(r.source, r.mix_block, r.mix_rank) for r in got}) == len(rows)


def test_one_period_deviates_less_than_a_block():
    for weights, period in (({"a": 5, "b": 3, "c": 1}, 64), ({str(i): i + 1 for i in range(20)}, 512), ({"x": 1}, 8), ({"h": 1000, "l": 1}, 128)):
        share = pfair.quotas(weights, period)
        total = sum(share.values())
        done = Counter()
        plan = pfair.one_period(share)
        assert [x[2] for x in plan] == list(range(total))
        for k, i, slot, release, deadline in plan:
            assert done[k] == i and release <= slot < deadline
            done[k] += 1
            assert all(abs(share[j] * (slot + 1) / total - done[j]) < 1 for j in share)
        assert done == share


def test_mix_orders_and_keeps_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("mix_k", F.lit("clash"))
    plan = {r.doc_id: (r.mix_slot, r.mix_rank) for r in pfair.schedule(docs.drop("mix_k")).collect()}
    pfair.mix(docs.drop("mix_k"), part_rows=300).write.parquet(f"{tmp_path}/m")
    rows = spark.read.parquet(f"{tmp_path}/m").select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.file_name, r.row_index))]
    assert order == sorted(plan, key=plan.get) and len(order) == docs.count()
    assert pfair.mix(docs.limit(0)).count() == 0


def test_importance_is_the_ratio_and_the_draw(spark):
    """Ratios, weights, noise and the k largest, worked out with plain integers and dictionaries."""
    import math
    import zlib

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    s = importance.Settings(buckets=512, share=0.6)
    held = {r[0] for r in docs.filter(F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(3)) == 0).select("doc_id").collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic} - held
    mask = (1 << 64) - 1

    def scramble(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    grams, raw, target = {}, Counter(), Counter()
    for i, t in rows.items():
        h = [zlib.crc32(w.encode()) + 1 for w in importance.TOKEN.findall(t)]
        grams[i] = [scramble(x) % s.buckets for x in h + [(a * 0x9E3779B97F4A7C15 + b) & mask for a, b in zip(h, h[1:])]]
        raw.update(grams[i])
        if i in good:
            target.update(grams[i])
    scale = target.total() / raw.total()
    weight = {i: sum(math.log((target[b] + s.prior) / (raw[b] * scale + s.prior)) for b in g) for i, g in grams.items() if g}
    noise = {i: -math.log(-math.log(((scramble(i ^ scramble(s.seed)) >> 11) + 0.5) / 2.0**53)) for i in weight}
    k = round(0.6 * len(weight))
    want = sorted(weight, key=lambda i: weight[i] + noise[i], reverse=True)[:k]
    got = importance.classify(docs, labels, s).collect()
    assert {r.doc_id for r in got if r.kept} == set(want)
    assert all(r.log_weight == pytest.approx(weight[r.doc_id], abs=1e-6) for r in got if r.n_features) and all(r.n_features == len(grams[r.doc_id]) for r in got)
    ids = sorted(r.doc_id for r in importance.keep_drawn(docs.withColumns({c: F.lit("clash") for c in ("row", "draw_key", "toxic", "quality")}), labels, s).collect())
    assert ids == sorted(want)
