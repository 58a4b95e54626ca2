"""Operators against brute force, the libraries, exact round trips and held-out labels."""

import hashlib
import io
import os
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakesift.llm import bits, common, decontamination, jaccard, media, packing, queries, substrings, vocabulary, warc
from lakesift.llm.components import components

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


# ------------------------------------------------------------------------------- tokens
def test_encoder_is_the_library(texts):
    enc = vocabulary.Encoder(vocabulary.default_path())
    odd = ["", " ", "it's they'LL don't.", "<|endoftext|> a<|startoftext|>b", "À é ́x", "ΣΑΣ σας İI", "a b　c d", "x.,;y!?z 3.14 ..a", "日本語 text", "\x1ca\x1db", "naïve.Été, ﬁ"]
    sample = odd + list(texts.values())[:60]
    expected = [x.ids for x in enc.model.encode_batch(sample, add_special_tokens=False)]
    ids, offsets = enc.batch(pa.array(sample))
    assert [list(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == expected
    assert list(enc.counts(pa.array(sample))) == list(map(len, expected))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    import public_tokenizers

    enc = vocabulary.Encoder(public_tokenizers.path(name))
    ids, offsets = enc.batch(pa.array(["Hello  world", None, "a\nb"]))
    assert offsets[1] == offsets[2] and len(ids) == offsets[-1] > 0 and list(enc.counts(pa.array(["Hello  world"]))) == [offsets[1]]


def test_words_are_lowered_only_where_the_vocabulary_does(tmp_path):
    import json

    with open(vocabulary.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert vocabulary.drops_white_space(spec)
    spec["normalizer"] = {"type": "NFC"}
    assert not vocabulary.drops_white_space(spec)
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    enc = vocabulary.Encoder(str(tmp_path / "cased.json"))
    assert list(enc.batch(pa.array(["Hello WORLD"]))[0]) == enc.model.encode("Hello WORLD", add_special_tokens=False).ids


def test_packing_query(spark, texts):
    enc = vocabulary.Encoder(vocabulary.default_path())
    expected = {}
    for doc, text in texts.items():
        ids = np.array([*enc.model.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            expected[doc, k] = (a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes()))
    found = queries.op1_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == expected
    ends = defaultdict(int)
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(ends.values()) // 4096) + 1


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=15))
def test_plan_fills_every_place_once(histogram):
    bins, seen = defaultdict(list), Counter()
    for length, a, b, first, each, offset in packing.plan(histogram, 60):
        for rank in range(a, b):
            bins[first + (rank - a) // each].append((offset + (rank - a) % each * length, length))
            seen[length, rank] += 1
    assert set(seen.values()) == {1} and Counter(n for n, _ in seen) == Counter(histogram)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 60
    # plain best-fit decreasing opens as many
    left: list[int] = []
    for length in sorted(Counter(histogram).elements(), reverse=True):
        fits = [k for k, x in enumerate(left) if x >= length]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= length
        else:
            left.append(60 - length)
    assert len(bins) == len(left)


def test_token_count_query(spark, texts):
    enc = vocabulary.Encoder(vocabulary.default_path())
    found = rows(queries.op5_token_counts(spark, SF))
    for doc, text in texts.items():
        n = len(enc.model.encode(text, add_special_tokens=False).ids)
        assert (found[doc]["n_bytes"], found[doc]["n_tokens"], found[doc]["over_limit"]) == (len(text.encode()), n, n > 2048)


# ------------------------------------------------------------------------------- similarity
def brute_links(texts):
    sets = {}
    for doc, text in texts.items():
        w = (text or "").encode().split()
        sets[doc] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    own = sorted({t: d for d, t in sorted(texts.items(), reverse=True)}.values())
    links, parent = Counter(), {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for d, t in sorted(texts.items()):
        parent[root(d)] = root(first.setdefault(t, d))
    for i, a in enumerate(own):
        for b in own[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    low = {}
    for d in sorted(texts):
        low.setdefault(root(d), d)
    return {d: (low[root(d)], links[first[t]], first[t]) for d, t in texts.items()}


def near_copies(n=260, groups=(1, 2, 3, 40, 120)):
    r, out = random.Random(8), {}
    words = [f"w{i}" for i in range(3000)]
    for size in groups:
        base = [r.choice(words) for _ in range(r.randrange(60, 240))]
        for _ in range(size):
            text = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 60))):
                text[r.randrange(len(text))] = r.choice(words)
            out[len(out)] = " ".join(text)
    while len(out) < n:
        out[len(out)] = " ".join(r.choice(words) for _ in range(r.randrange(1, 90)))
    return out


@pytest.mark.parametrize("part", [256, 16])  # with 16 most buckets are split twice more
def test_links_and_classes(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "SKETCH_PART", part)
    texts = near_copies()
    found = rows(jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    expected = brute_links(texts)
    assert {d: (r["class_id"], r["n_links"], r["copy_id"]) for d, r in found.items()} == expected
    assert max(x[1] for x in expected.values()) > 20


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_recall_of_paths_at_the_threshold(levels):
    r, found, n = np.random.default_rng(4), 0, 400
    for _ in range(n):
        pool = r.integers(0, 2**63, 180, dtype=np.uint64)
        tokens = jaccard.embed(np.concatenate([pool[:162], pool[18:]]), np.array([0, 162, 324]))  # similarity 0.8
        row, path = jaccard.chosen_paths(tokens, levels=levels)
        found += bool(set(path[row == 0]) & set(path[row == 1]))
    assert found >= 0.985 * n


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    named = jaccard._keyed
    monkeypatch.setattr(jaccard, "_keyed", lambda docs: [F.lit(5).cast("long").alias("hash"), named(docs)[1]])
    docs = spark.createDataFrame([(1, "some words"), (2, "other words"), (3, "some words")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"], r["n_copies"]) for r in jaccard.jaccard_join(docs).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 10: 10, 11: 10, 7: 7}


# ------------------------------------------------------------------------------- repeats
def brute_repeats(texts, window):
    split = [(d, (t or "").encode().split()) for d, t in texts]
    counts = Counter(tuple(w[i:i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize(("window", "first", "alphabet"), [(35, 18, 40), (7, 2, 3), (8, 4, 2), (5, 5, 2)])
def test_repeats(spark, window, first, alphabet):
    r = random.Random(window)
    shared = [" ".join(f"s{r.randrange(300)}" for _ in range(50)) for _ in range(4)]
    texts = []
    for i in range(90):
        own = " ".join(f"w{r.randrange(alphabet)}" for _ in range(r.randrange(0, 60)))
        texts.append((i, own + " \t" + r.choice(shared)[r.randrange(30):] + "\n" + own[:r.randrange(1 + len(own))] if i % 3 else own))
    texts += [(0, texts[1][1]), (200, "x " * 80), (201, None)]
    found = substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), window, first).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in found) == brute_repeats(texts, window)


def test_hashes_depend_on_words_alone():
    a, b = common.text_words("one two  three\tfour"), common.text_words("zero one two three")
    assert (common.gram_hashes(a, 3)[0] == common.gram_hashes(b, 3)[1]) and len(set(a) | set(b)) == 5
    assert len(common.gram_hashes(a, 9)) == 0 and len(common.text_words(None)) == 0


def test_filter_lets_all_through(spark):
    hashes = common.mix(np.arange(5000, dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in hashes[:1000].view(np.int64)], "h long")
    own = bits.build(df, "h")
    assert own.holds(hashes[:1000]).all() and own.holds(hashes[1000:]).mean() < 0.2


# ------------------------------------------------------------------------------- benchmark
def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_decontamination_recall_and_exactness(spark):
    r = random.Random(6)
    words = [f"v{i}" for i in range(500)]
    items = [(i, [r.choice(words) for _ in range(r.randrange(8, 50))]) for i in range(40)]
    docs, edits = [], {}
    for i in range(400):
        item, base = items[i % 40]
        text, k = list(base), r.randrange(0, int(len(base) * 0.2) + 1)
        for _ in range(k):
            at = r.randrange(len(text))
            text[at:at + 1] = r.choice([[r.choice(words)], [], [text[at], r.choice(words)]])
        before = [r.choice(words) for _ in range(r.randrange(0, 80))]
        docs.append((i, " ".join(before).title() + " -- " + ", ".join(text) + ". " + " ".join(r.choice(words) for _ in range(40))))
        edits[i] = item
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in found}
    own = dict(items)
    expected = {}
    for d, text in docs:
        seq = re.findall(r"[a-z0-9]+", text.lower())
        for i, w in items:
            n = len(w)
            if len(set(w) & set(seq)) >= n * 0.6:
                best = min(plain_distance(seq[s:s + n], w) for s in range(max(1, len(seq) - n + 1)))
                if best <= int(n * 0.2):
                    expected[d, i] = best
    assert set(got) <= set(expected) and len(got) >= 0.99 * len(expected) and len(expected) > 250
    assert all(got[k] >= expected[k] for k in got) and sum(got[k] == expected[k] for k in got) >= 0.97 * len(got)
    assert own and edits


@pytest.mark.parametrize("n", [1, 2, 12, 33])
def test_edit_distances(n):
    r = np.random.default_rng(n)
    a, b = r.integers(1, 4, (80, n)).astype(np.uint64), r.integers(1, 4, (80, n)).astype(np.uint64)
    b[:40, n // 3:] = np.roll(a[:40], 1, axis=1)[:, n // 3:]  # some are near
    plain = [plain_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)]
    assert list(decontamination.edit_distances(a, b)) == plain
    for k in (0, 1, n // 5, n):
        assert list(decontamination.edit_distances(a, b, k)) == [min(d, k + 1) for d in plain]
        sizes = np.maximum(1, n - np.arange(len(a)) % 4)
        assert list(decontamination.edit_distances(a, b, k, sizes)) == [min(plain_distance(list(x[:m]), list(y)), k + 1) for x, y, m in zip(a, b, sizes, strict=True)]


# ------------------------------------------------------------------------------- files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=700), min_size=2, max_size=6), st.sampled_from([media.XIPH_LACING, media.EBML_LACING]), st.integers(1, 200))
def test_lacing(frames, lacing, track):
    body = media.lace(frames, track, -5, lacing, key=False)
    found_track, relative, key, ranges = media.frames_of(body, 0, len(body))
    assert (found_track, relative, key) == (track, -5, False) and [body[a:b] for a, b in ranges] == frames


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(content):
    payload = media.padded(content)
    data = media.write_samples(payload)
    file = media.parse(data)
    assert b"".join(data[p.begin:p.end] for p in file.packets) == payload and payload.startswith(content) and len(payload) % 576 == 0
    assert [c[2] for c in file.cues] == file.clusters and file.tracks[1]["bits"] == 8
    for cut in (1, 30, len(data) - 3):
        with pytest.raises(ValueError):
            media.parse(data[:cut])


def test_long_media_has_clusters():
    data = media.write_samples(bytes(576 * 1300))
    file = media.parse(data)
    assert len(file.clusters) == 3 and [c[2] for c in file.cues] == file.clusters and file.packets[-1].timestamp == 1299 * 12_000_000 and file.duration == 1300 * 12_000_000


def test_media_query(spark, texts):
    for doc, r in rows(queries.op8_media_columns(spark, SF)).items():
        raw = texts[doc].encode()
        payload = raw + bytes([255]) * (-len(raw) % 576 if raw else 576)  # by hand, not by the module
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload))
        samples, frames = np.frombuffer(payload, dtype=np.uint8).astype(int), len(payload) // 576
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert {k: int(v) for k, v in said.items()} == {"tracks": 1, "packets": frames, "clusters": -(-frames // 512), "cues": -(-frames // 512), "ms": frames * 12, "sum": sum(samples), "steps": sum(abs(np.diff(samples))), "distinct": len(set(samples))}


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    data = warc.write_zip([("a/b.txt", b"one"), ("c", b"two" * 999)], zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("c") == b"two" * 999 and z.testzip() is None
    members = warc.zip_members(lambda at, n: data[at:at + n], len(data))
    assert [(m.name, m.size) for m in members] == [("a/b.txt", 3), ("c", 2997)]
    at = warc.data_at(lambda a, n: data[a:a + n], members[0])
    assert data[at:at + 3] == b"one"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x", b"y")
        z.comment = b"PK\x05\x06 in a comment"
    raw = other.getvalue()
    assert warc.zip_members(lambda at, n: raw[at:at + n], len(raw))[0].name == "x"
    with pytest.raises(ValueError):
        warc.zip_members(lambda at, n: b"no archive"[at:at + n], 10)


# ------------------------------------------------------------------------------- queries
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    found, expected = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    own = sorted(found.columns)
    assert own == sorted(expected.columns)
    plain = lambda df: sorted(tuple("" if v is None or type(v).__name__ == "NAType" or v != v else str(int(v)) if isinstance(v, (float, np.integer)) else str(v) for v in r) for r in df[own].itertuples(index=False))
    assert plain(found) == plain(expected)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    found = [r for r in queries.op4_toxicity(spark, SF01).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in found)
    wrong_clean = sum(r["predicted"] == 1 and labels[r["doc_id"]] == 0 for r in found)
    assert right >= 0.9 * len(found) and wrong_clean <= 1


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if re.match(r"op\d", x)} and "pipeline" in names
