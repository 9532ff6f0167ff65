"""Centroid clustering, conversation repair and the license scan against brute force, with
nulls, empty, long and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int, row string, cells string, cluster string, v string"
TURNS = "conv_id long, turn long, role string, text string, conv string, fault string, copies string, audit string"
TEXTS = "doc_id long, text string, score string, spans string, labels string, n_words string"


# ---------------------------------------------------------------- centroid clustering


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [max(-(1 << 26), min(1 << 26, int(np.floor(256 * float(x))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centers = [v for _, v in sorted(kept, key=lambda r: (*name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    ends = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in ends if c == j) for j in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in ends), key=str)


@pytest.mark.parametrize("case", ["mixed", "equal", "few", "none"])
def test_centroids(spark, case):
    from clausediff.llm.centroids import clustered

    rng = np.random.default_rng(3)
    dims, k = 8, 6
    rows = [(i, rng.normal(scale=0.2 if i % 3 else 4.0, size=dims).astype(np.float32).tolist()) for i in range(150)]
    if case == "mixed":
        rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[2][1]), (7, rows[1][1]), (200, None), (201, []), (202, rows[0][1][:7]), (203, [*rows[0][1], 1.0])]
        rows += [(204, [None, *rows[0][1][1:]]), (205, [float("nan"), *rows[0][1][1:]]), (206, [float("inf"), *rows[0][1][1:]]), (207, [0.0] * dims), (208, [1e30, -1e30] * 4), (209, [300.5] * dims)]
    elif case == "equal":
        rows = rows[:40] + [(1000 + i, rows[0][1]) for i in range(120)]
    elif case == "few":
        rows = rows[:4]
    else:
        rows = [(1, None), (2, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "own", "own", "own", "own") for i, v in rows], VECTORS).repartition(3)
    got = sorted(map(tuple, clustered(df, k=k, rounds=3, dims=dims).collect()), key=str)
    assert got == brute_clusters(rows, k, 3, dims)
    if case == "few":
        assert len({r[1] for r in got}) == 4 and clustered(df.limit(0), k=k, dims=dims).count() == 0


def test_centroid_intervals():
    """Every true distance lies in its interval, and most centroids are ruled out by the cells alone."""
    from clausediff.llm.centroids import Lookup, packed_cells, unpacked_cells

    rng = np.random.default_rng(4)
    v = (rng.normal(size=(500, 16)) * 60 + rng.integers(0, 5, 500)[:, None] * 90).astype(np.int64)
    middle, ranges = np.median(v, 0).astype(np.int64), []
    for d in range(16):
        starts = np.unique(np.append(v[:, d].min(), np.quantile(v[:, d], np.arange(1, 64) / 64).astype(np.int64)))
        ranges.append(np.stack([starts, np.append(starts[1:] - 1, v[:, d].max())]))
    cells = unpacked_cells(packed_cells(v, ranges, 6), 16, 6)
    centers = v[::50]
    low, high = Lookup(centers, middle, ranges, 6).intervals(cells, ((v - middle) ** 2).sum(1))
    true = ((v[:, None] - centers) ** 2).sum(2)
    assert (low <= true).all() and (true <= high).all()
    left = Lookup(centers, middle, ranges, 6).left(cells, ((v - middle) ** 2).sum(1))
    assert left[np.arange(500), true.argmin(1)].all() and left.sum(1).mean() < 5


# ---------------------------------------------------------------- conversation repair

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            out += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def brute_repair(rows):
    rows = hurt(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    best = {"": (0, "", ())}

    def inserting():
        for _ in range(2):
            for (p, step), q in STEPS.items():
                if step != "s" and p in best:
                    c, a, o = best[p]
                    best[q] = min(best.get(q, (9e9, "")), (c + 3, a + "I", (*o, f"{NAMES[step]}:")))

    inserting()
    for (_, role, text), fault in zip(rows, faults):
        now = {}
        for p, (c, a, o) in best.items():
            ways = [(p, (c + 4, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for (at, step), q in STEPS.items():
                    if at == p:
                        ways += [(q, (c + more, a + "K", (*o, f"{role}:{text}")))] * (role[:1] == step)
                        ways += [(q, (c + more + 3, a + "R", (*o, f"{NAMES[step]}:{text}")))] if step != "s" else []
            for q, way in ways:
                now[q] = min(now.get(q, (9e9, "")), way)
        best = now
        inserting()
    cost, audit, out = min(best[q] for q in ("", "a") if q in best)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(rng):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Yes.", "Ünder.\x0b", "a\nb.", "x" * 30000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "u"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 5]), role, rng.choice(texts) if rng.random() < 0.4 else f"t{turn}."))
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Hi."), (None, 1, "assistant", "Hm.")]
    rows += [(900, t, ("user", "assistant")[rng.random() < 0.5], rng.choice(texts)) for t in range(700)] + rows[:9] * 2
    return rows


def test_conversations(spark):
    from clausediff.llm.conversations import repaired

    rows = conversations(random.Random(2))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    df = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], TURNS).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repaired(df).collect()}
    assert got == {c: brute_repair(r) for c, r in by.items()}
    assert repaired(df.limit(0)).count() == 0


def test_conversation_of_lost_rows(spark):
    from clausediff.llm.conversations import repaired

    lost = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*lost, "user", "Hi."), (5_000_000, -(1 << 62), "user", "Hi."), (5_000_000, (1 << 63) - 1, "user", "Ho.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repaired(df).collect()}
    assert got[lost[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got[5_000_000][0] == (1 << 63) - 1


def test_cyk_least_strings():
    """Cells of cut spans against every string of edits."""
    from clausediff.llm.conversations import CUT, FINE, GONE, Growing, _code, least

    def every(rows):
        best = (9e9, "")
        for edits in product("DIKR", repeat=len(rows) + 3):
            for n in range(len(rows), len(rows) + 4):
                if sum(e != "I" for e in edits[:n]) == len(rows):
                    best = min(best, price(rows, "".join(edits[:n])))
        return best

    def price(rows, edits):
        place, cost, left = "", 0, list(rows)
        for e in edits:
            initial, fault = (None, FINE) if e == "I" else left.pop(0)
            if e == "D":
                cost += 4
                continue
            step = initial if e == "K" else "a" if place == "u" else "u"
            if fault == GONE or (place, step) not in STEPS:
                return 9e9, ""
            place = STEPS[place, step]
            cost += (0 if e == "K" else 3) + 3 * (fault == CUT)
        return (cost, edits) if place in ("", "a") else (9e9, "")

    rng = random.Random(8)
    for _ in range(40):
        rows = [(rng.choice("suax"), rng.choice((FINE, FINE, CUT, GONE))) for _ in range(rng.randrange(0, 5))]
        growing = Growing()
        for r in rows:
            growing.add(_code(*r))
        assert least(growing.span()) == every(rows)


# ---------------------------------------------------------------- license scan

SMALL = [("one", "a b c d e f g h i j"), ("two", "c d e x f g h"), ("three", "a a b a a c a a"), ("four", "q r")]
BASE = [("mit", "mit license"), ("aa", "a a")]


def brute_scan(text, long, gap, covered):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    places = [(i, label) for label, phrase in BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    score, labels, spans = 1.0 if places else 0.0, {label for _, label in places}, []
    for label, template in SMALL:
        t = template.split()
        least, stat = min(long, len(t)), []
        for i in range(len(w)):
            stat.append(max((n for n in range(min(i + 1, len(t)) + 1) if any(t[j : j + n] == w[i - n + 1 : i + 1] for j in range(len(t) - n + 1))), default=0))
        matches = [(i, n) for i, n in enumerate(stat) if n >= least and (i + 1 == len(w) or stat[i + 1] != n + 1)]
        chains, own = [], []
        for i, n in matches:
            new = []
            for e in [j + n - 1 for j in range(len(t) - n + 1) if t[j : j + n] == w[i - n + 1 : i + 1]]:
                had, first = 0, i - n + 1
                for doc_end, t_end, have, began in chains:
                    if t_end < e and doc_end < i and e - n - t_end <= gap and i - n - doc_end <= gap:
                        gain = have - max(0, n - min(n, e - t_end, i - doc_end))
                        if gain > had or gain == had and gain > 0 and began > first:
                            had, first = gain, began
                new.append((i, e, had + n, first))
            chains += new
            for _, _, have, first in new:
                score = max(score, have / len(t))
                if have / len(t) >= covered:
                    if own and first <= own[-1][1]:
                        own[-1] = (first, i, have) if have >= own[-1][2] else own[-1]
                    else:
                        own.append((first, i, have))
        spans += [(label, a, b, c / len(t)) for a, b, c in own]
    labels |= {s[0] for s in spans}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), score, sorted(spans))


def test_licenses(spark):
    from clausediff.llm.licenses import license_spans

    rng = random.Random(6)
    texts = [None, "", " ", "A a A", "MIT License", "mit\x00licénse mit-license", "é MIT license. Mit LICENSE", "a b c d e f g h i j", "q. r", "Q R q r"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(SMALL)[1].split()
            a = rng.randrange(len(t))
            parts += t[a : a + rng.randrange(1, 9)] + [rng.choice("abcxyz")] * rng.randrange(3)
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    texts.append("a " * 3000)
    rows = [(i, t, *["own"] * 4) for i, t in enumerate(texts)] + [(None, "MIT license", *["own"] * 4)] + [(0, None, *["own"] * 4)]
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    got = license_spans(df, BASE, SMALL, long=3, gap=2, covered=0.7)
    seen = sorted(((r.doc_id, *list(r)[1:8], sorted(map(tuple, r.spans))) for r in got.collect()), key=str)
    assert seen == sorted(((i, *brute_scan(t, 3, 2, 0.7)) for i, t, *_ in rows), key=str)
    assert license_spans(df.limit(0)).count() == 0


def test_license_notices():
    from clausediff.llm import licenses

    scanner = licenses.Scanner()
    label = lambda text: ",".join(sorted({scanner.labels[t] for _, _, t, _ in scanner.scan(text).spans}))
    assert label("Licensed under CC BY-NC 4.0.") == "cc-by-nc" and label("Licensed under CC BY-NC-SA 4.0") == "cc-by-nc-sa" and label("licensed under cc by 4.0") == "cc-by"
    bsd = "Redistribution, and use in source or binary forms, with or without modification, are permitted provided that the following conditions are met:"
    assert label("x " * 50 + bsd) == "bsd" and label("the use of source forms is permitted") == ""
    for n in (licenses.PIECE - 9, licenses.PIECE - 3, licenses.PIECE):
        found = scanner.scan("y" * n + " released under the MIT license " + "z " * licenses.PIECE)
        assert (found.n_words, found.n_base, found.first) == (6 + licenses.PIECE, 1, 4) and len(found.spans) == 1


# ---------------------------------------------------------------- pipeline and n-gram join

#: Every name that stages or their operators add to a table of documents, and more.
ADDED = (
    "_row score _own_score kept_text n_bytes n_removed n_spans kept_sha256 _copies copies size taken target source_size row before _part _o_row s place runs runs_ "
    "component_id n_shingles prefix f1 f2 h n z x i turn shard quality label twice first kept weights c l count own_column_5_of_docs a.b SCORE_"
).split()


def test_stages_keep_own_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)] + [None, "", "x " * 20]
    texts += [texts[0], texts[1] + " " + texts[2], " ".join(word() for _ in range(400_000))]  # a copy, passages, 2.4 MB
    rows = [(i, t, "en", f"s{i % 2}", 1, *(f"{c}{i}" for c in ADDED)) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", None, 1, *(f"{c}n" for c in ADDED)), rows[4]]
    from pyspark.sql import types as T

    kinds = {"doc_id": T.LongType(), "n_chars": T.LongType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in (*corpus_pipeline.DOCUMENT, *ADDED)])
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            own = {c: r[c] for c in ADDED}
            end = "n" if r.doc_id is None else str(r.doc_id)
            assert own == {c: f"{c}{end}" for c in ADDED}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path))
    assert packed.columns[:3] == ["doc_id", "start", "length"] and packed.select("doc_id").distinct().count() == len(texts) + 1


@pytest.mark.parametrize("order", ["counted", "flat"])
def test_ngram_join_of_shared_passages(spark, monkeypatch, order):
    """Documents that share 45 % of their text and link with nothing meet on few rows, also
    where the counters tell nothing; two copies among them are found."""
    from clausediff.llm import ngram_join

    met = {}
    stored = ngram_join.stored

    def counting(df, name, texts=False):
        out = stored(df, name, texts)
        met[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    if order == "flat":
        levels = ngram_join.order_levels
        flat = np.zeros(1 << ngram_join.COUNTER_BITS, np.uint8)
        monkeypatch.setattr(ngram_join, "order_levels", lambda docs, k=5, salt=1: levels(docs, k, salt) if salt > 1 else flat)
    passage = [f"s{i}" for i in range(140)]
    rows = [(i, " ".join(passage + [f"u{i}x{j}" for j in range(170)])) for i in range(400)]
    rows += [(400, rows[7][1] + " more"), (401, rows[9][1])]
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r.doc_id, r.component_id) for r in got.where("component_id <> doc_id").collect()} == {(400, 7), (401, 9)}
    assert met["used"] < 10 * len(rows) and met["open"] < len(rows) and met["candidates"] < 10


# ---------------------------------------------------------------- archives


def test_blocks_merge_externally():
    """Many more blocks than are held at a time; ties; empty runs."""
    from clausediff.llm.warc import BlockMerge

    rng = random.Random(5)
    runs = [sorted((b"%05d" % rng.randrange(20_000), r, i) for i in range(rng.randrange(400, 900))) for r in range(12)]
    runs += [[(b"00007", 12, i) for i in range(300)], []]
    blocks = [(run[at][0], r, at, run[at : at + 16]) for r, run in enumerate(runs) for at in range(0, len(run), 16)]
    merge, out = BlockMerge(), []
    for _, _, _, rows in sorted(blocks, key=lambda b: b[:3]):
        out += merge.add(rows)
    out += merge.rest()
    assert [r[0] for r in out] == sorted(r[0] for run in runs for r in run) and sorted(out) == sorted(r for run in runs for r in run)
    assert len(blocks) > 400 and merge.most <= len(runs) + 300 // 16 + 2
    one = BlockMerge()
    assert list(one.add([(b"a",)])) == [] and list(one.rest()) == [(b"a",)] and list(BlockMerge().rest()) == []


def test_captures_in_order(spark, monkeypatch):
    """Small runs, blocks and ranges, with columns that clash."""
    from clausediff.llm import warc

    monkeypatch.setattr(warc, "RUN_ROWS", 40)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 7)
    monkeypatch.setattr(warc, "RANGE_ROWS", 60)
    rng = random.Random(9)
    rows = [(i, rng.choice(["http://a.org/x", f"https://b.org/{rng.randrange(30)}", None, f"http://c.{i % 3}.org/"]), "p" * (i % 9) * 300, "own", "own", "own") for i in range(400)]
    rows += [(None, "http://a.org/x", None, "own", "own", "own"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, range_id string, place string, record_type string").repartition(5)
    got = warc.archived(df).orderBy("range_id", "place").collect()
    assert len(got) == len(rows) and len({r.range_id for r in got}) > 2
    keys = [(r.url_key, r.captured_at) for r in got]
    assert keys == sorted(keys)
    by = {}
    for r in got:
        by.setdefault(r.range_id, []).append(r.place)
    assert all(p == list(range(len(p))) for p in by.values())


# ---------------------------------------------------------------- suffix dedup


def test_heavy_grams_are_dealt_out(spark, monkeypatch):
    """Grams with more blocks than may meet in one task, against brute force."""
    from clausediff.llm import suffix_dedup
    from test_operators import brute_repeats

    monkeypatch.setattr(suffix_dedup, "KEY_BLOCKS", 2)
    met = []
    stored = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name, texts=False: met.append(name) or stored(df, name, texts))
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(130) for _ in range(4)]
    rows = [(i, word(rng.randrange(50)) + rng.choice(shared) + word(rng.randrange(80)) + rng.choice(shared)[: rng.randrange(90, 130)] + word(9)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, shared[0][:99]), (103, "ab" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == brute_repeats(rows) and met.count("remaining") == 2


# ---------------------------------------------------------------- URL filter


def test_aliases_of_pages(spark):
    """Canonical links and refreshes in html, against brute force and against the query's own SQL;
    own columns that clash."""
    import duckdb

    from clausediff.llm import url_filter

    rng = random.Random(4)
    urls = [f"http://{h}/{p}/{i}" for i, (h, p) in enumerate((h, p) for h in ("A.net", "example.org", "b.com", "c.example.org") for p in ("es", "en", "de", "fr", "x") for _ in range(6))]
    written = [
        '<link rel="canonical" href="{}">', "<LINK href='{}' data-x=1 rel=canonical>", '<link rel="stylesheet" href="no.css"><link\nrel="canonical"\nhref="{}"/>',
        '<meta http-equiv="refresh" content="0; url={}">', "<meta content='5;URL={}' http-equiv='Refresh'>", '<link rel="canonicals" href="http://b.com/de/0">',
    ]
    rows, edges = [], []
    for i, u in enumerate(urls):
        html = "<html>"
        if rng.random() < 0.5:
            to, how = rng.choice(urls), rng.choice(written)
            kind = rng.randrange(3)
            host, path = to[7:].split("/", 1)
            said = to if kind else ("//" + to[7:] if rng.random() < 0.5 else f"/{path}")
            if not kind and not said.startswith("//"):
                to = u[:7] + u[7:].split("/", 1)[0] + f"/{path}"
            html += how.format(said + rng.choice(["", "#part"]))
            if "canonicals" not in how:
                edges.append((u, to))
        rows.append((i, u + rng.choice(["", "#top"]), html, "own", "own", "own"))
    rows += [(500, None, '<link rel="canonical" href="http://b.com/de/1">', "own", "own", "own"), (501, "no scheme", None, "own", "own", "own"), (502, "", "", "own", "own", "own"), rows[3]]
    schema = "page_id long, url string, html string, verdict string, u string, component string"
    got = sorted((tuple(r) for r in url_filter.judged(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=str)
    group = {}
    for a, b in edges:
        whole = group.get(a, {a}) | group.get(b, {b})
        for x in whole:
            group[x] = whole

    def decide(url):
        host, _, path = url.partition("://")[2].partition("/")
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (host.lower() == h or host.lower().endswith("." + h)) and f"/{path}".startswith(p)] if "://" in url else []
        return max(fits)[1] if fits else None

    want = {}
    for i, u, *_ in rows:
        bare = (u or "").split("#")[0]
        votes = {decide(x) for x in group.get(bare, {bare})} - {None}
        want[i] = decide(bare) or min(votes, default="allow")
    assert {r[0]: r[4] for r in got} == want and len(got) == len(rows) and sum(v == "block" for v in want.values()) > 15
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in rows[:-1]])
    assert sorted(con.sql(url_filter.ORACLE).fetchall(), key=str) == sorted(set(got), key=str)


# ---------------------------------------------------------------- line rules


def brute_kept(text, phrases, keep_share, symbol_share, notice_share):
    """The verdict by a loop over lines."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(hit) > 20 * len(words):
        return False
    solid = lambda t: sum(c not in " \t\n\x0b\x0c\r" for c in t)
    seen, stays = set(), 0
    for line in text.split("\n"):
        if not solid(line) or line in seen:
            continue
        seen.add(line)
        n = len(line)
        symbols, bars = sum(c in "#*$%&|<>" for c in line), sum(c in "|»›·" for c in line)
        low = line.lower()
        notice = n - len(re.sub(phrases, "", low))
        loud = n >= 12 and line.upper() == line and low != line
        stub = n < 30 and bars >= 1 and not re.search(r"[.!?…:;。！？]", line)
        if not (loud or symbols > symbol_share * n or bars >= 2 and bars * 40 > n or stub or notice and notice >= notice_share * n):
            stays += solid(line)
    return stays >= keep_share * solid(text)


def test_line_rules_verdict(spark):
    from clausediff.llm import line_rules as rules

    rng = random.Random(13)
    lines = [
        "Home | News | Sports | Weather", "HOME PAGE OF ALL THINGS", "Read » more", "Please accept all cookies", "We set the cookie policy out at some length here, and it says what it says to all who read on.",
        "### $$$ ***", "", "  \t", "A plain line of words that goes on for a while, then ends.", "Short one", "Tous droits réservés", "x", "ÉTÉ ÉTÉ ÉTÉ ÉTÉ", "café | thé",
    ]
    texts = [None, "", "\n\n", "one two", "LOUD WORDS IN ONE LINE, TEN OF THEM OR MORE HERE NOW"]
    for _ in range(400):
        made = [rng.choice(lines) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 9))]
        texts.append("\n".join(made))
    texts.append("\n".join(f"Line{i} of{i} a{i} long text{i}, with{i} words{i}." for i in range(20_000)))
    rows = [(i, t, "own", "own", "own") for i, t in enumerate(texts)] + [(None, texts[40], "own", "own", "own"), (40, texts[40], "own", "own", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, lines string, s string").repartition(3)
    got = {r.doc_id: r.kept for r in rules.line_cleaned(df).collect()}
    slow = lambda t: True if t is not None and len(t) > 500_000 else brute_kept(t, rules.BOILERPLATE, rules.KEEP_SHARE, rules.SYMBOL_SHARE, rules.NOTICE_SHARE)
    want = {i: slow(t) for i, t, *_ in rows}
    assert got == want and 100 < sum(want.values()) < 390


# ---------------------------------------------------------------- nearest neighbours


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_query_vectors_by_id(spark, monkeypatch, most):
    """Probes carry ids; query vectors are found by broadcast, or by a join beyond its bound; own columns."""
    from clausediff.llm import ann

    monkeypatch.setattr(ann, "ASKED_BYTES", most)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=12).tolist(), "own", "own", "own") for i in range(240)]
    rows += [(i + 1000, rows[i][1], "own", "own", "own") for i in range(0, 60, 3)] + [(7, rows[7][1], "own", "own", "own"), (None, rows[1][1], "own", "own", "own"), (2000, None, "own", "own", "own"), (2001, [0.0] * 12, "own", "own", "own")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket string, vec string, score string").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v is not None and any(v)}
    hits = 0
    for q in [i for i in vectors if i % 20 == 0]:
        want = sorted(((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q))[:5]
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and len(got[q]) == 5
        assert all(abs(s - float((vectors[q] * vectors[v]).sum())) < 1e-12 for v, s in got[q])
        hits += len({v for v, _ in got[q]} & {i for _, i in want})
    assert hits >= 0.9 * 5 * len(got) and set(got) == {i for i in vectors if i % 20 == 0}
