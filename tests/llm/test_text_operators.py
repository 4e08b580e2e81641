"""Operators over documents against plain Python, on odd rows: nulls, empty and long texts, repeats, clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from mnemora.llm import best_fit, byte_bpe, common, cutting_stock, graph, identifiers, licenses, near_duplicates, quality, tokens
from mnemora.llm.common import prepared

WORDS = [f"w{i}" for i in range(400)]


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=120)) for _ in range(12)]
    near = []
    for t in base[:4]:  # a group of near copies, each with a few words changed
        for _ in range(6):
            w = t.split()
            for i in rng.sample(range(120), rng.choice([1, 2, 3])):
                w[i] = rng.choice(WORDS)
            near.append(" ".join(w))
    pii = "call me at a.b@c.org or +1 (555) 010-9999, host 10.0.0.256 and 10.0.0.7, card 4111-1111 1111 1111 é a@b.c_x@y.zz"
    licence = "CC by. X\nReleased under the MIT License\nall rights, RESERVED: general public license"
    odd = [None, "", " \n\t ", "one two", "one two", pii, licence, "a" * 3000, " ".join(["so so it is"] * 40)]
    odd += ["# * $ line\n# * $ line\nother", "zwölf <|endoftext|> Boxkämpfer\n\n\n   x", base[0], base[0].upper()]
    return [(i, t) for i, t in enumerate(base + near + odd)]


ROWS = texts()
ROWS += [ROWS[3], (None, ROWS[0][1])]  # a repeated row and a null id


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id bigint, text string, band string, node bigint, row int, _class int"
    rows = [(i, t, "x", 1, 2, 3) for i, t in ROWS]
    return prepared(spark).createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 0 if t and "so so" in t else 1, 0) for i, t in ROWS if i is not None]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def empty(docs):
    return docs.where("false")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(docs):
    sets = {i: shingles(t) for i, t in ROWS if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = near_duplicates.linked_classes(docs).collect()
    assert len(found) == len(ROWS)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]))
            assert r["kept"] == (r["doc_id"] == root(r["doc_id"]))
    assert near_duplicates.linked_classes(empty(docs)).count() == 0


def test_one_of_each_group_stays(docs):
    kept = near_duplicates.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    classes = near_duplicates.linked_classes(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    assert ids == sorted(r["doc_id"] for r in classes.collect())


def test_many_ids_are_shuffled(docs, monkeypatch):
    whole = sorted(near_duplicates.keep_one_of_each(docs).collect(), key=repr)
    monkeypatch.setattr(common, "MAX_BROADCAST_IDS", -1)
    assert sorted(near_duplicates.keep_one_of_each(docs).collect(), key=repr) == whole


def test_leftovers_are_linked_in_cells(docs, monkeypatch):
    """Without stars, and with blocks of a few shingles, the cells alone find the same classes."""
    whole = sorted(near_duplicates.linked_classes(docs).collect(), key=repr)
    monkeypatch.setattr(near_duplicates, "PART_SHINGLES", 1)  # every member meets its hub in a part of its own
    assert sorted(near_duplicates.linked_classes(docs).collect(), key=repr) == whole
    monkeypatch.setattr(near_duplicates, "STARS", 0)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 200)
    assert sorted(near_duplicates.linked_classes(docs).collect(), key=repr) == whole


def test_cells_link_every_pair_near_the_threshold(spark, monkeypatch):
    """Pairs of similarity 0.757 to 0.807 that only the cells can link."""
    rng = random.Random(11)
    rows = []
    for pair in range(3000):
        base, tail = [[f"{pair}x{rng.random()}" for _ in range(104)] for _ in range(2)]
        n = 12 + pair % 5
        rows += [(2 * pair, " ".join(base + tail[:n])), (2 * pair + 1, " ".join(base + tail[n : 2 * n]))]
    table = prepared(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    monkeypatch.setattr(near_duplicates, "STARS", 0)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.linked_classes(table).collect()}
    assert [i for i, c in found.items() if c != i - i % 2] == [] and len(found) == 6000


def test_sketch_agreement_estimates_similarity():
    a, b = np.arange(1, 2001, dtype=np.uint64), np.arange(401, 2401, dtype=np.uint64)
    sketch = near_duplicates.sketches([a, b, np.array([7], dtype=np.uint64)])
    assert (sketch != near_duplicates._EMPTY).all()
    assert abs((sketch[0] == sketch[1]).mean() - 1600 / 2400) < 0.15


def test_quality_matches_plain_counts(docs, labels):
    found = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality.quality_report(docs, labels).collect()}
    for i, t in ROWS:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = list(zip(words, words[1:], words[2:], strict=False))
        repeated = {k for j, w in enumerate(windows) if windows.count(w) > 1 for k in (j, j + 1, j + 2)}
        r = found[i, len(words), sum(map(len, words))]
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["n_dup_lines"] == sum(x in lines[:j] for j, x in enumerate(lines))
        assert r["n_repeat_words"] == len(repeated)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_report(empty(docs), labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).columns == docs.columns


def test_forest_and_threshold_separate_odd_rows():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 6)), rng.normal(9, 1, (20, 6))])
    scores = quality.Forest(x).scores(x)
    assert scores[-20:].min() > np.quantile(scores[:2000], 0.99)
    assert quality.calibrate([(10, 1000, 0), (700, 1, 50), (600, 60, 3)]) == 0.7
    assert quality.calibrate([]) > 1


def spans_of(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            fine = {
                "email": True,
                "ip": all(int(p) < 256 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(d) <= 19 and luhn % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if fine else []
    return ",".join(out)


def test_identifiers_match_plain_patterns(docs):
    found = {(r["doc_id"], r["base_sha256"]): r for r in identifiers.identifier_report(docs).collect()}
    for i, t in ROWS:
        base = spans_of(t)
        r = found[i, hashlib.sha256(base.encode()).hexdigest()]
        assert set(base.split(",")) <= set(r["spans"].split(","))
    assert identifiers.identifier_report(empty(docs)).count() == 0
    masked = identifiers.mask_identifiers(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert not [r for r in masked.collect() if r["text"] and spans_of(r["text"])]


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"some words here mail to u{i}@host.org and more") for i in range(8)]
    rows += [(99, "other words here mail to u99@localhost and more"), (100, "nothing at 77 here")]
    found = {
        r["doc_id"]: r["spans"]
        for r in identifiers.identifier_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    }
    assert found[99] == "email:25:38" and found[100] == ""


def test_context_finds_identifiers_in_groups(spark):
    rows = [(i, f"please reach phone +49301234{i:03} now, on 12 call +49409876{i:03} too") for i in range(8)]
    rows += [(50, "please reach phone 030 123 4567 now"), (51, "please reach phone (030) 765 - 4321, 8 times")]
    rows += [(52, "on 12 call 0301234567 then"), (53, "a@b.org 7 8, 9")]
    table = prepared(spark).createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["text"] for r in identifiers.mask_identifiers(table).collect()}
    assert found[50] == "please reach phone [phone] now"
    assert found[52] == "on 12 call [phone] then" and found[53] == "[email] 7 8, 9"
    spans = identifiers.candidate_spans(identifiers.F.col("text"), identifiers.base_spans(identifiers.F.col("text")))
    values = {r["doc_id"]: [s["value"] for s in r["s"]] for r in table.select("doc_id", spans.alias("s")).collect()}
    assert values[51] == ["030) 765 - 4321", "8"] and values[53] == ["7 8", "9"] and values[0] == ["12"]


@pytest.mark.parametrize("pack", ["cutting", "best_fit"])
def test_packing_is_lossless(docs, pack):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(cutting_stock.default_path())
    ids = {(i, t): tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in ROWS}
    if pack == "cutting":
        rows = cutting_stock.pack_documents(docs, with_ids=True).collect()
        places = {}
        for r in rows:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for s in places.values():
            s.sort()
            assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
            assert sum(n for _, n in s) <= 2048
        got = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in rows]
        assert cutting_stock.pack_documents(empty(docs)).count() == 0
    else:
        got = []
        for r in best_fit.packed_matrices(docs).collect():
            flat, place = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4")
            assert len(flat) == len(place) == 2048
            for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                assert (place[a:b] == np.arange(b - a)).all()
                got.append((d, s, flat[a:b].tobytes()))
        assert best_fit.packed_matrices(empty(docs)).count() == 0
    want = [
        (i, s, np.array(ids[i, t][s : s + 2048], "<u4").tobytes()) for i, t in ROWS for s in range(0, len(ids[i, t]), 2048)
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_word_is_encoded_once_whatever_ends_it(monkeypatch):
    encoder, encoded = tokens.Encoder(tokens.default_path()), []
    plain = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda keys: (encoded.extend(keys), plain(keys))[1])
    words = [f"zqu{a}{b}ß" for a in "bcdfg" for b in "hjklm"]
    text = "\n".join(f"and {w} {w}, {w}. {w}!! {w}.$$$ {w}9)" for w in words)
    assert encoder.encode([text])[0] == np.array(encoder.tokenizer.encode(text).ids, encoder.dtype).tobytes()
    assert len(encoded) <= 2 * len(words) + 10


def test_chunks_have_the_ids_of_the_whole_text():
    encoder, rng = tokens.Encoder(tokens.default_path()), random.Random(6)
    parts = ["don't", "'s", "'", ",", ".$", "--", "_", "×", "÷", "²", "ª", "中", "ǆ", "ɐ", "Ж", "é", "ab", "Z9", "7", "!", "~`", "\x1c", "\0"]
    parts += [" ", " ", " ", "\n", "\n", "  ", "\t", "\xa0", "<|endoftext|>", "\u0301", "😀", "we'll,"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(6000)]
    texts += ["".join(rng.choices(parts[:-11] + [" ", " "], k=rng.randrange(1, 14))) for _ in range(6000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, encoder.dtype).tobytes(), text


def test_encoder_takes_columns_and_keeps_repeated_chunks_only():
    import pyarrow as pa

    encoder = tokens.Encoder(tokens.default_path())
    once = [f"zq{a}{b}v" for a in "bcdfghjklm" for b in "npqrstvwxz"]
    texts = [" ".join(["the cat", *once[at : at + 10], "sat,"]) for at in range(0, 100, 10)]
    texts += ["the\n\n\ncat  sat", "", "the <|endoftext|> cat", "中 the\tcat\n"]
    plain = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for column in (pa.array(["x", *texts]).slice(1), pa.array(texts)):
        assert encoder.encode(column) == [np.array(x.ids, encoder.dtype).tobytes() for x in plain]
        assert {"cat", "sat"} < set(encoder.cache) and not set(once) & set(encoder.cache)
    assert encoder.encode(pa.array([], pa.string())) == []


def test_texts_are_encoded_in_slices_of_bounded_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "TEXTS", 4)
    monkeypatch.setattr(tokens, "TEXT_BYTES", 100)
    rows = ["a" * 60, None, "b b " * 15, "é c" * 125, "", *["d"] * 9, "e" * 101]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])
    seen, encode = [], tokens.Encoder.encode

    def noted(self, texts):
        seen.append([len(t.encode()) for t in texts.to_pylist()])
        return encode(self, texts)

    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, task, _: task

    monkeypatch.setattr(tokens.Encoder, "encode", noted)
    for step in (cutting_stock.cut_pieces, best_fit.token_rows):
        seen.clear()
        out = pa.Table.from_batches(step(Docs(), tokens.default_path())(iter([batch, batch[:0]])))
        assert out["doc_id"].to_pylist() == list(range(len(rows)))
        assert [n for part in seen for n in part] == [len((t or "").encode()) for t in rows]
        assert all(len(part) == 1 or len(part) <= 4 and sum(part) <= 100 for part in seen)
        assert len(seen) == 7


def test_merges_across_line_feeds_do_not_join_words(tmp_path):
    import json

    own = json.load(open(tokens.default_path()))
    merges = own["model"]["merges"]
    merges.insert(0, ["a", "\u010a"] if isinstance(merges[0], list) else "a \u010a")
    own["model"]["vocab"]["a\u010a"] = len(own["model"]["vocab"]) + 1
    path = str(tmp_path / "own.json")
    json.dump(own, open(path, "w"))
    text = " ".join(f"zq{x}va" for x in "bcdfghjklm")
    for encoder in map(tokens.Encoder, (tokens.default_path(), path)):
        assert encoder.encode([text])[0] == np.array(encoder.tokenizer.encode(text).ids, encoder.dtype).tobytes()


def test_patterns_cover_the_demand_and_waste_little():
    rng = np.random.default_rng(3)
    demand = np.bincount(rng.integers(1, 200, 5000), minlength=257)[1:257]
    found = cutting_stock.patterns(demand)
    assert (sum(c * n for c, n in found) == demand).all()
    assert all((c * np.arange(1, 257)).sum() <= 256 for c, _ in found)
    assert sum(n for _, n in found) <= 1.02 * (demand * np.arange(1, 257)).sum() / 256 + 2
    assert cutting_stock.patterns(np.zeros(256, dtype=int)) == []


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 2049, 400)
    rooms, plain = [], {}
    for p in np.argsort(-lengths, kind="stable"):
        fitting = [(r, k) for k, r in enumerate(rooms) if r >= lengths[p]]
        k = min(fitting)[1] if fitting else len(rooms)
        if not fitting:
            rooms.append(2048)
        rooms[k] -= lengths[p]
        plain[int(p)] = k
    assert len(best_fit.best_fit(lengths)) == len(rooms)


def test_licenses_match_plain_phrases(docs):
    found = {}
    for r in licenses.scan_licenses(docs).collect():
        found.setdefault(r["doc_id"], r)
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    for i, t in ROWS:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, base = [], set()
        for label, p in phrases.items():
            at = [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
            places, base = places + at, base | ({label} if at else set())
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(base)) and base <= set(r["labels"].split(",")) | set()
        assert 0 <= r["score"] <= 1
    assert "mit" in found[[i for i, t in ROWS if t and "MIT" in t][0]]["labels"]
    assert licenses.scan_licenses(empty(docs)).count() == 0


def test_license_index_finds_every_block_over_the_threshold():
    rng = random.Random(8)
    sets = licenses.template_sets()
    words = sorted(frozenset().union(*[t for _, t in sets]))
    index = licenses.Index(sets, {w: rng.randrange(50) for w in words})
    for _ in range(3000):
        base = list(rng.choice(sets)[1])
        block = rng.sample(base, rng.randint(len(base) * 3 // 4, len(base))) + rng.choices(words, k=rng.randrange(20))
        want = {label for label, t in sets if len(t & set(block)) >= licenses.needed(t)}
        assert {label for label, _, _ in index.passing(block)} == want


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n"
    "# Public License as published by",
}


def test_licenses_are_found_across_lines(spark):
    scattered = " ".join(w + " filler" * 40 for w in WRAPPED["bsd"].replace("*", "").split())
    rows = [(label, f"{label} code\n{t}\nmore") for label, t in WRAPPED.items()] + [("", scattered)]
    rows += [("mit", f"{'filler ' * 5000}{WRAPPED['mit']} {'filler ' * 5000}".replace("\n", " "))]  # one long line
    table = prepared(spark).createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(table).collect()}
    assert [found[i] for i in range(len(rows))] == [label for label, _ in rows]


def test_license_windows_match_brute_force():
    rng = random.Random(12)
    sets = licenses.template_sets()
    index = licenses.Index(sets, {})
    for _ in range(400):
        _, base = rng.choice(sets)
        words = rng.sample(sorted(base), len(base)) + [b"filler"] * rng.randrange(2 * len(base))
        rng.shuffle(words)
        words = [b"filler"] * rng.randrange(30) + words + rng.choices(sorted(base), k=rng.randrange(9))
        want = {}
        for label, t in sets:
            width = licenses.WINDOW * len(t)
            blocks = [words[i : i + width] for i in range(len(words))]
            most = max(len(t.intersection(b)) for b in blocks)
            if most >= licenses.needed(t):
                want[label] = max(want.get(label, 0), most / len(t))
        assert index.found(words) == want


def test_license_labels_do_not_depend_on_the_length_of_a_line():
    index = licenses.Index(licenses.template_sets(), {})
    template = licenses.words_of(b"Permission is hereby granted free of charge to any person obtaining a copy of this software")
    spread = [[w, *[b"filler"] * 16] for w in template]
    for total in (255, 256, 257, 1000):
        line = sum(spread, [])[:total] + [b"filler"] * (total - 17 * len(template))
        assert index.found(line) == {}
        assert index.found(line + template) == {"mit": 1.0}


def test_quality_is_the_same_in_one_pass_and_in_two(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["red", "blue", "green", "#", "tree", "house"], k=rng.randrange(40, 120))) for _ in range(300)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, None, "b"), (7, "", "c")]
    docs = prepared(spark).createDataFrame(rows, "doc_id bigint, text string, s string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    report = quality.quality_report(docs, labels).where("kept").groupBy("doc_id").count().collect()
    stays = quality.keep_good(docs, labels).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, stays)) == sorted(map(tuple, report)) and 20 < len(report) < 300


def test_repeats_of_one_piece_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(cutting_stock, "RANKED", 50)
    docs = prepared(spark).range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "id AS _number")
    found = cutting_stock.pack_documents(docs).collect()
    assert len(found) == 400 and len({(r["sequence_id"], r["offset"]) for r in found}) == 400
    assert all(r["length"] == 1 and 0 <= r["offset"] < 2048 for r in found)


def test_components_of_a_long_chain(spark):
    edges = prepared(spark).range(300).selectExpr("id AS u", "id + 1 AS v")
    assert {r["component"] for r in graph.components(edges).collect()} == {0}


@pytest.mark.parametrize("limit", [0, 50, 400_000])
def test_byte_bpe_matches_the_library(docs, limit):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {(r["doc_id"], r["decoded_sha256"]): r for r in byte_bpe.bpe_report(docs, limit=limit).collect()}
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        r = found[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_distinct_chunks_are_split_once_and_give_the_words_of_the_text(monkeypatch):
    import pyarrow as pa

    split, plain = [], byte_bpe.split_words
    monkeypatch.setattr(byte_bpe, "split_words", lambda t: (split.append(t), plain(t))[1])
    rng = random.Random(9)
    parts = ["don't", "'s", "we'll,", ",", ".$", "_", "²", "中", "ɐ", "Ж", "é", "ab", "Z9", "7", "!", "\0", "\u0301", "😀"]
    parts += [" ", " ", " ", "\n", "\n", "  ", "\t", "\xa0"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(4000)]
    texts += ["".join(rng.choices(parts[:-4], k=rng.randrange(14))) for _ in range(4000)]
    texts += ["", "\n", " ", "ab\n\n", *[" ".join(["it is, so", *["don't"] * 500])] * 100]
    keys, starts, ends = tokens.chunked(pa.array(texts))
    words, codes = byte_bpe.chunk_words(keys.dictionary).to_pylist(), keys.indices.to_pylist()
    assert len(split) <= len(keys.dictionary) < len(codes) / 4
    for text, a, b in zip(texts, starts.tolist(), ends.tolist(), strict=True):
        assert [w for code in codes[a:b] for w in words[code]] == plain(text), text


def test_byte_bpe_sends_its_pairs_once(spark):
    """Each place that names the literal would send it again with every task."""
    fold = byte_bpe.Fold(byte_bpe.read_ranks(byte_bpe.default_path()))
    words = prepared(spark).createDataFrame([(w,) for w in ["zquß", "a", "\ue000\ue001", "中中", " \x00\x01", "x" * 70]], "word string")
    frame = words.select("word", fold(common.F.col("word")).alias("t"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 2
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    assert all(r["t"] == byte_bpe.heap_merged(r["word"].encode(), ranks) for r in frame.collect())


def test_fold_goes_on_from_starts_made_in_columns(spark):
    """Rare words come with their tokens of one byte and the merges of their neighbours; only later pairs are looked up."""
    import pyarrow as pa

    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    chars = {chr(byte_bpe.FIRST + r): t for t, r in ranks.items()}
    rng = random.Random(4)
    words = ["".join(rng.choices(" aeinrst'é中😀\0\n$", k=rng.randrange(1, 14))) for _ in range(600)]
    words += ["a", "\0" * 9, "\ue000\ue001", "aaaaaaa", "x" * 256, "é" * 128]
    starts = byte_bpe.Starts(ranks)(pa.array(["left out", *words])[1:])
    for word, start in zip(words, starts.to_pylist(), strict=True):
        raw = word.encode()
        edge, *pieces, last = start["pieces"]
        assert edge == last == byte_bpe.EDGE and [chars[p] for p in pieces] == [raw[i : i + 1] for i in range(len(raw))]
        pairs = [raw[i : i + 2] if i >= 0 and len(raw) > i + 1 else b"" for i in range(-1, len(raw))]
        assert [chars.get(n, b"") for n in start["next"]] == [p if p in ranks else b"" for p in pairs]
        assert len(start["next"]) == len(raw) + 1
    assert len(byte_bpe.Starts(ranks)(pa.array([], pa.string()))) == 0
    table = pa.table({"rare": pa.ListArray.from_arrays(pa.array([0, 0, 200, len(words)], pa.int32()), starts)})
    frame = prepared(spark).createDataFrame(table).select(byte_bpe.Fold(ranks).each(common.F.col("rare")).alias("t"))
    assert frame._jdf.queryExecution().analyzed().toString().count("from_json") == 1
    found = [t for r in frame.collect() for t in r["t"]]
    assert sorted(found) == sorted(byte_bpe.heap_merged(w.encode(), ranks) for w in words)


def test_words_split_alike():
    import public_tokenizers
    import regex

    rng = random.Random(2)
    alphabet = "ab Z9 ½é'sßx-\t\n  \x85\x1c　中ǆ.,'ll"
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randrange(1, 12)))
        assert "".join(byte_bpe.split_words(t)) == t
        if "\x1c" not in t and "\x85" not in t:
            assert byte_bpe.split_words(t) == regex.findall(public_tokenizers.PATTERN, t)


def test_an_id_with_several_texts_has_the_links_of_all_of_them(spark):
    """Each id has two texts; each text has a near copy under another id, and an exact one now and then."""
    said = lambda seed, n=60: " ".join(f"w{(seed * 7919 + k * k * 31) % 100_003}" for k in range(n))
    rows = []
    for i in range(20):
        rows += [(i, said(2 * i)), (i, said(2 * i + 1)), (100 + i, said(2 * i) + " and a tail"), (200 + i, said(2 * i + 1) + " or so")]
        rows += [(300 + i, said(2 * i + 1))] if i % 3 == 0 else []
    rows += [(400, said(0) + " and another"), (400, said(38) + " joins two groups")]
    table = common.prepared(spark).createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, node bigint")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.linked_classes(table).collect()}
    smallest = {i: i for i in range(20)} | {19: 0}
    assert found == {i: 0 if i == 400 else smallest[i % 100] for i, _ in rows}


def test_encoder_cache_is_bounded_and_changes_nothing(monkeypatch):
    from mnemora.llm import tokens

    path = tokens.default_path()
    texts = [" ".join(f"chunk{i * j % 977}" for j in range(40)) + "x" * 300 for i in range(300)] + ["<|endoftext|> a b"]
    plain = tokens.Encoder(path)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 30_000)
    small = tokens.Encoder(path)
    for at in range(0, len(texts), 7):
        assert small.encode(texts[at : at + 7]) == [plain.encode([t])[0] for t in texts[at : at + 7]]
        assert sum(len(c) + len(i) + tokens.ENTRY_BYTES for c, i in small.cache.items()) < 30_000 + 1_000
        assert max(map(len, small.cache), default=0) <= tokens.CACHED_LENGTH
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "bc", "É", "\xa0", "\0", "'s", "12", "!?", "\x1c", "\x85", "foo", "  \n", "\n\n", "漢字", "😀"]
    rng = random.Random(3)
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)] + ["\n\n", "a\n\n", " a", "a ", "\n"]
    assert plain.encode(odd) == [np.array(x.ids, dtype=plain.dtype).tobytes() for x in plain.tokenizer.encode_batch(odd, add_special_tokens=False)]
    whole = plain.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert list(np.frombuffer(plain.encode(texts[:1])[0], dtype=plain.dtype)) == whole
