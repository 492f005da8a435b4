"""Main text by votes: labelled pages, a plain twin, and cases where the votes change the outcome."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from cloakwork.llm import pages

S = pages.Settings()


def sentence(rng, n=18):
    return " ".join(rng.choice(["river", "stone", "garden", "winter", "letter", "market", "window", "story", "über", "naïve"]) + rng.choice(["", "s", ","]) for _ in range(n)) + f" {rng.randrange(10**6)}."


def labelled(seed=1, hosts=6, per_host=12):
    """(url, html, lines of the article): opaque class names, menus, notices, adverts, reader comments."""
    rng, out = random.Random(seed), []
    for h in range(hosts):
        a, b, c, d, e = (f"q{rng.choice('abcdefgh')}{x}" for x in "klmno")
        opened, closed = [("<article>", "</article>"), (f"<div class={a}><div class={b}>", "</div></div>"), (f"<main class={a}>", "</main>"), (f"<div class='{a} {b}'><section class={c}>", "</section></div>")][h % 4]
        for p in range(per_host):
            lines = [f"Title {rng.randrange(10**6)}", *(sentence(rng, rng.randrange(12, 40)) for _ in range(rng.randrange(3, 9)))]
            text = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
            box = f"<div class={d}><p>Join our circle, it is free, and read what others think of it, every week.</p></div>"
            cut = text.index("</p>") + 4
            menu = "<div class=" + e + ">" + "".join(f"<a href=/{rng.randrange(99)}>{sentence(rng, 4)}</a> " for _ in range(6)) + "</div>"
            notes = "".join(f"<div class=zz{h}><p>{sentence(rng, 9)}</p></div>" for _ in range(30 if p == 3 else rng.randrange(3)))
            html = f"<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav>{menu}<div class=ad>{sentence(rng, 7)}</div>{opened}{text[:cut]}{box}{text[cut:]}{closed}{notes}<footer><p>all rights</p></footer></body></html>"
            out.append((f"http://www.host{h}.org/{p}", html, lines))
    return out


def twin(rows, s=S):
    """Verdicts and texts by plain sums over a host's pages."""
    votes, hashes, node = defaultdict(Counter), defaultdict(set), {}
    for url, html in rows:
        found, nodes = pages.blocks(html or "", s)
        of = pages.sums(found, nodes, s)
        for path, x in of.items():
            at = pages.host_of(url or ""), path
            size, all_worth = max(1, of[0].chars), max(1, of[0].worth)
            votes[at].update(pages=1, chars=x.chars * 10**6 // size, linked=x.linked * 10**6 // size, running=x.running * 10**6 // size, worth=x.worth * 10**6 // all_worth, around=10**6 * (of[0].worth > 0))
            hashes[at].add(x.same & (1 << 64) - 1 if x.chars else None)
            node[at] = nodes[x.node], nodes[nodes[x.node].above].path
    win, out, climbs = defaultdict(set), defaultdict(set), defaultdict(set)
    for (host, path), v in votes.items():
        if path:
            named, few, minor = node[host, path][0].named, v["pages"] < s.consensus, v["worth"] <= s.minor * v["around"]
            dull = named or v["chars"] and v["linked"] >= s.linked * v["chars"] or not few and v["chars"] and len(hashes[host, path]) == 1
            if minor and dull or few and named:
                out[host].add(path)
            elif v["worth"] > 0 and v["worth"] >= s.share * v["around"]:
                win[host].add(path)
    for host, paths in win.items():
        for path in paths:
            above = node[host, path][1]
            if above and above not in out[host]:
                around, tag = Counter(votes[host, above]), node[host, above][0].tag
                for x in out[host]:
                    if node[host, x][1] == above:
                        around.subtract(votes[host, x])
                inside = votes[host, path]
                size, linked, running, worth = (around[c] - inside[c] for c in ("chars", "linked", "running", "worth"))
                prose = worth >= s.section * inside["worth"]
                if size == 0 or 3 * linked <= size and (running >= s.prose * size if prose else tag not in ("body", "center", "table", "tbody")):
                    climbs[host].add(path)
    hosts = [pages.host_of(u or "") for u, _ in rows]
    found = [pages.Verdict(frozenset(win[h]), frozenset(climbs[h]), frozenset(out[h]), bool(win[h] or out[h])) for h in hosts]
    return [pages.main_text(html or "", v, s) for v, (_, html) in zip(found, rows)]


def measured(got, rows):
    hit = sum(len(set(g.split("\n")) & set(lines)) for g, (_, _, lines) in zip(got, rows))
    return hit / sum(len(lines) for _, _, lines in rows), hit / max(1, sum(len(g.split("\n")) for g in got))


def test_labelled_pages(spark, monkeypatch):
    rows = labelled()
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = [r.text for r in sorted(pages.extract(df).collect(), key=lambda r: r.page_id)]
    assert got == twin([r[:2] for r in rows])
    recall, precision = measured(got, rows)
    assert recall == 1.0 and precision > 0.99
    monkeypatch.setattr(pages, "SKIP_NAME", frozenset())  # names aren't decisive where pages agree
    assert measured(twin([r[:2] for r in rows]), rows) == pytest.approx((recall, precision), abs=0.02)


def test_votes_change_the_outcome():
    """On one page of each host the comments are longer than the article; the box inside is told by its equal text."""
    rows = labelled(2)
    voted, alone = twin([r[:2] for r in rows]), [pages.main_text(h) for _, h, _ in rows]
    assert sum(v != a for v, a in zip(voted, alone)) >= 12
    assert measured(voted, rows)[1] > 0.99 > measured(alone, rows)[1]


def test_driver_pages(spark, monkeypatch):
    frame = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(u, h) for u, h in zip(frame.url, frame.html)]
    got = {r.page_id: r.text for r in pages.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    assert [got[i] for i in frame.page_id] == twin(rows)
    monkeypatch.setattr(pages, "SKIP_NAME", frozenset())
    assert sum(a == b for a, b in zip(twin(rows), (got[i] for i in frame.page_id))) >= 0.98 * len(rows)
    for text, (_, html) in zip((got[i] for i in frame.page_id), rows):
        inner = re.search(r"<article>(.*)</article>", html or "", re.S)
        if inner:
            whole = "".join(re.sub("<[^>]*>", "", pages.entities.unescape(inner[1])).split())
            assert "".join(text.split()) == whole


def test_paths_beyond_what_a_host_hands_on(spark):
    rows = labelled(3)
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = [r.text for r in sorted(pages.extract(df, pages.Settings(paths=1)).collect(), key=lambda r: r.page_id)]
    recall, precision = measured(got, rows)
    assert recall > 0.97 and precision > 0.6


def test_equal_votes_and_odd_rows(spark):
    half = "<p>One, two, three words that run long enough to count as running text in here.</p>"
    page = f"<html><body><div class=left>{half}</div><div class=right>{half}</div></body></html>"
    rows = [(1, "http://t.org/1", page), (1, "http://t.org/2", page), (None, "http://t.org/3", page), (2, None, page), (3, "http://t.org/4", None), (4, "", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS winners", "2 AS left_out", "3 AS path", "4 AS of_host", "5 AS whole")
    got = pages.extract(df).collect()
    assert len(got) == 6 and len({r.text for r in got if r.n_chars and r.n_chars < 1000}) == 1
    assert [r.n_chars for r in got if r.page_id == 4] == [200_000] and [r.text for r in got if r.page_id == 3] == [""]
