"""Urls, conversations, vectors and the pipeline."""

import os
import random
import sys

import compare
import numpy as np
import pytest

from mnemora.llm import chat, permutation_index, queries, url_rules
from mnemora.llm.common import prepared

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.S))
def test_query_equals_sql(name, spark, folder):
    assert compare.difference(queries.Q[name](spark, folder), compare.connect(folder), queries.S[name]) is None


def pages(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.NET/x?y", "x://example.net/en/1", "x://e.example.net/en"]
    urls += ["https://b.example.com/de/?q#f", "https://a.org/fr/", "https://a.org/fr", "ftp://u@h:8/p#://z", "http://q?a/b"]
    urls += [f"https://spam{i % 3}.info/buy/{i}.html?id={i}" for i in range(60)]
    urls += [f"https://good{i % 3}.info/read/{i}.html?id={i}" for i in range(60)]
    rows = [(i, u, None, "host") for i, u in enumerate(urls)] + [(5, urls[5], None, "host"), (None, urls[20], None, "host")]
    return prepared(spark).createDataFrame(rows, "page_id bigint, url string, html string, items string"), urls


def test_urls_follow_rules_and_mined_combinations(spark):
    table, urls = pages(spark)
    known = [(i, 0 if "/buy/" in u else 1, 0) for i, u in enumerate(urls) if u and ".info" in u and i % 3]
    labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    found = {r["page_id"]: r for r in url_rules.judge_urls(table, labels).collect()}
    assert len(found) == len(urls) + 1
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [
            (len(h + p), h + p, v)
            for v, h, p in url_rules.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        assert (found[i]["host"], found[i]["path"]) == (host, path)
        assert found[i]["rule"] == (max(fits)[1] if fits else None)
        blocked = max(fits)[2] if fits else "block" if "/buy/" in (u or "") else "allow"
        assert found[i]["verdict"] == blocked, u
    assert found[None]["verdict"] == "block"
    assert url_rules.judge_urls(table, labels.where("false")).count() == len(urls) + 2
    assert url_rules.judge_urls(table.where("false"), labels).count() == 0


def test_every_part_of_a_url_can_become_a_rule(spark):
    """Blocked names in places that vary: inner label, deep folder, slug word, query value; and a rare host."""
    bad = {
        "label": lambda i: f"https://s{i}.casino-win.site{i}.com/en/{i}",
        "folder": lambda i: f"https://a{i}.org/x{i}/bonus/{i}/z",
        "slug": lambda i: f"https://b{i}.org/y/{i}-jackpot-{i}a",
        "value": lambda i: f"https://c{i}.org/y/p?id={i}&q=pills",
    }
    urls = [(f(i), 0) for f in bad.values() for i in range(12)]
    urls += [(f"http://rare.example.net/{'abcdef'[i % 6]}{i}", 0) for i in range(12)]
    urls += [(f"https://d{i}.org/{'xy'[i % 2]}/fine-{i}?id={i}&q=ok", 1) for i in range(12_000)]
    asked = [f(77_777) for f in bad.values()] + ["http://rare.example.net/new", "https://d7.org/y/fine-3?id=9&q=ok"]
    table = prepared(spark).createDataFrame(
        [(i, u) for i, (u, _) in enumerate(urls)] + [(10**6 + i, u) for i, u in enumerate(asked)], "page_id bigint, url string"
    )
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(urls)], "doc_id bigint, quality int, toxic int")
    found = url_rules.judge_urls(table, labels).where("page_id >= 1000000").orderBy("page_id").collect()
    assert [r["verdict"] for r in found] == ["block"] * 5 + ["allow"]


def test_chat_reads_back(spark):
    rng = random.Random(6)
    pieces = [*chat.CONTROL, *map(chat.broken, chat.CONTROL), "\\", "\\\\", "<", "|", "[", "a\n", "é", " "]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choices(pieces, k=6))) for c in range(40) for t in range(6)]
    rows += [(90, t, "assistant", str(t)) for t in range(400)]  # longer than a block, one message
    rows += [(91, None, None, None), (None, 1, "<s>", ""), (92, 1, "user", "x"), (92, 1, "user", "x"), (93, 0, "assistant", None)]
    kind = "conv_id bigint, turn bigint, role string, text string"
    table = spark.createDataFrame([(*r, "z") for r in rows], kind + ", segments string")
    con = compare.connect("/root/testdata/sf0.001")
    con.execute("DROP VIEW conversations")
    con.execute("CREATE TABLE conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said, ""), (-7, 1, "assistant", said, "")], kind + ", segments string")
    sql = chat.chat_sql().replace("ORDER BY turn, role", "ORDER BY turn NULLS FIRST, role")
    assert compare.difference(chat.chat_report(table.union(planted)), con, sql) is None
    out = chat.format_conversations(table).where("conv_id = 90").first()
    assert len(out["loss_spans"]) == 400 and out["formatted"].count(chat.TURN) == 1
    assert "".join(out["formatted"][a:b] for a, b in out["loss_spans"]) == "".join(map(str, range(400)))
    assert chat.chat_report(table.where("false")).count() == 0


def test_neighbours_are_found(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (1500, 24)) + 3 * rng.normal(0, 1, (12, 24))[rng.integers(0, 12, 1500)]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    rows += [(2000 + i, rows[0][1], "a") for i in range(30)]  # a group of copies, query 0 and query 2000 among them
    odd = [(None, rows[1][1]), (5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] * 24), (5400, [])]
    rows += [(*o, "a") for o in odd] + [rows[7], (6000, [1.0, 2.0], "a"), (6001, [1.0, 3.0], "a")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, class string").repartition(4)
    monkeypatch.setattr(permutation_index, "FILE_ROWS", 20)
    found = {}
    for r in permutation_index.nearest(table).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in [i for i in fine if i % 100 == 0]:
        near = sorted((float(np.sqrt(((v - fine[q]) ** 2).sum())), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        got = sorted(found.pop(q))
        assert [r for r, _, _ in got] == list(range(1, min(10, len(near)) + 1))
        assert all(abs(s - dict((i, d) for d, i in near)[v]) < 1e-12 for _, v, s in got)
        hits, total = hits + len({v for _, v, _ in got} & {i for _, i in near[:10]}), total + len(got)
        if q in (0, 2000):
            assert [v for _, v, _ in got] == [i for _, i in near[:10]]
    assert not found and hits >= 0.9 * total
    assert permutation_index.nearest(table.where("false")).count() == 0


def test_a_rare_length_has_its_own_pivots(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(0, 1, (2000, 16)), rng.normal(0, 1, (40_000, 2))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_001 + i, v.tolist()) for i, v in enumerate(y)]
    found = permutation_index.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 500).toPandas()
    hits = total = 0
    for q, got in found[found["query_id"] < 10_000].groupby("query_id"):
        hits += len(set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]) & set(got["vec_id"]))
        total += 10
    assert total == 40 and hits >= 0.8 * total


@pytest.mark.parametrize("exact", [False, True])
def test_recall_of_long_vectors(spark, exact):
    x = np.random.default_rng(4).normal(0, 1, (4000, 256))
    table = prepared(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = permutation_index.nearest(table, 200, exact=exact).toPandas()
    hits = 0
    for q, got in found.groupby("query_id"):
        hits += len(set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]) & set(got["vec_id"]))
    assert len(found) == 200 and hits >= (200 if exact else 180)


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    table = prepared(spark).read.parquet(f"{folder}/embeddings.parquet")
    pdf = table.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    found = permutation_index.nearest(table).toPandas()
    hits = 0
    for q, rows in found.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        near = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(near) & set(rows["vec_id"]))
    assert hits >= 0.9 * len(found)


def test_pipeline_keeps_its_contracts(spark, folder):
    docs = prepared(spark).read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
    pieces = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}
