"""Small fixtures for every operator: nulls, empties, ties, repeats, extra columns, and plain versions of the results."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import common, language_id, line_dedup, near_copies, packing, segment_bpe, simhash, sketch, suffix_dedup, suffix_windows, token_rollup, warc  # noqa: E402
from plumbline.llm.chunks import ChunkPool  # noqa: E402
from plumbline.llm.components import connected_components  # noqa: E402
from plumbline.llm.exact_dedup import DedupIndex, exact_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who".split()


CLASHES = "digest h1 fp t1 t2 id part keep b run kept copies _text _u1 _u2 _drop _keep u1 u2 row drop n_lines n_dropped lang_pred score node component stay label k a.b".split()


def clashing(spark, rows):
    """Rows of (doc_id, text) with columns of many clashing names, each row's own value in them."""
    out = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return out.select("*", *[F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-9))).alias(c) for c in CLASHES])


def assert_untouched(spark, out, but=()):
    for r in out.collect():
        assert all(r[c] == f"{c}{-9 if r['doc_id'] is None else r['doc_id']}" for c in CLASHES if c not in but)


def docs(spark, rows):
    """Rows of (doc_id, text), with further columns whose names clash with internal ones."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    out = spark.createDataFrame(full, SCHEMA)
    for c in ("digest", "h1", "fp", "t1", "id", "part", "keep", "b", "run"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (300, 120, 80, 40, 12, 500)]
    shared = prose(rng, 60)
    out = [(k, t) for k, t in enumerate(base)]
    out += [(10, base[0]), (11, base[0].replace(" ", "\t ")), (12, None), (13, ""), (14, "  \n "), (15, base[1] + " x"), (16, "a " + shared + " b"), (17, "c " + shared), (18, "Z" * 900), (19, "é" * 450 + base[2])]
    out += [(20, base[0]), (20, base[0]), (None, base[3]), (None, "only here"), (21, base[5][:1000] + "!" + base[5][1001:]), (22, "x" * 5000), (23, "word"), (24, "word"), (-5, "12 34 , .")]
    return out


# --- 1 ---


def plain_exact(rows):
    import re

    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def test_exact_dedup(spark, rows):
    got = exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for text, ids in plain_exact(rows).items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, first, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(plain_exact(rows)) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_in_batches_with_collisions(spark, rows):
    d = docs(spark, rows)
    index = DedupIndex(spark, digest_bytes=1)  # digests of a byte collide; the bytes of the texts decide
    index.insert(d.where("doc_id < 12"))
    index.insert(d.where("doc_id >= 12 OR doc_id IS NULL"))
    got = Counter((r["id"], r["keep_id"], r["group_size"]) for r in index.assign().collect())
    want = Counter((i, min((j for j in ids if j is not None), default=None), len(ids)) for ids in plain_exact(rows).values() for i in ids)
    assert got == want
    index = DedupIndex(spark)
    index.insert(d)
    text = hashlib.sha256(b"word").digest()
    assert index.find([text]).first()["n"] == 2


def test_exact_dedup_levels(spark, rows, monkeypatch):
    from plumbline.llm import exact_dedup as module

    monkeypatch.setattr(module, "MEMTABLE", 2)
    monkeypatch.setattr(module, "FANOUT", 3)
    index = DedupIndex(spark)
    for k in range(3):
        index.insert(docs(spark, rows[k::3]))
    assert [len(level) for level in index.levels] == [0, 2, 2]  # 24 runs of level 0
    text = hashlib.sha256(b"word").digest()
    assert index.find([text]).first()["n"] == 2
    got = Counter((r["id"], r["keep_id"], r["group_size"]) for r in index.assign().collect())
    assert got == Counter((i, min((j for j in ids if j is not None), default=None), len(ids)) for ids in plain_exact(rows).values() for i in ids)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_hot_group(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    got = exact_dedup(docs(spark, [(k, "same" if k % 2 else f"own {k}") for k in range(60)])).collect()
    assert sum(r["kept"] for r in got) == 31 and all(r["group_size"] == 30 for r in got if r["keep_id"] == 1)


# --- 2 ---


def plain_suffix(rows, t=200):
    seen = Counter(raw[p : p + t] for _, x in rows for raw in [(x or "").encode()] for p in range(len(raw) - t + 1))
    out = []
    for i, x in rows:
        raw = (x or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - t + 1):
            if seen[raw[p : p + t]] > 1:
                gone[p : p + t] = True
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(raw)))
        out.append((i, len(raw), int(gone.sum()), int(spans), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_suffix_dedup(spark, rows):
    got = suffix_dedup.suffix_dedup(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_suffix(rows)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_overlapping_passages(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, 80) for _ in range(4)]
    made = []
    for k in range(30):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, 120)
            parts.append(p[a : a + rng.choice([150, 199, 200, 201, 260, 330])] if rng.random() < 0.7 else prose(rng, 30))
        made.append((k, rng.choice(["", " ", "~"]).join(parts)))
    made += [(90, "ab" * 300), (91, "q" * 199), (92, "q" * 199)]
    got = suffix_dedup.suffix_dedup(docs(spark, made)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_suffix(made)


def test_suffix_rewrite_keeps_columns(spark, rows):
    d = docs(spark, rows)
    out = suffix_dedup.suffix_dedup(d, rewrite=True)
    assert out.columns == d.columns and out.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[0] == "" and kept[12] is None and kept[23] == "word"


def test_clashing_names_keep_their_values(spark, rows):
    rows = rows[:4] + rows[6:14] + rows[16:20]
    d = clashing(spark, rows)
    out = suffix_dedup.suffix_dedup(d, rewrite=True)
    assert out.columns == d.columns and out.count() == len(rows)
    assert_untouched(spark, out)
    out = line_dedup.line_dedup(d)
    assert set(out.columns) == set(d.columns) and out.count() == len(rows)
    assert_untouched(spark, out, ("n_lines", "n_dropped"))
    out = simhash.drop_near_copies(d)
    assert out.columns == d.columns
    assert_untouched(spark, out)
    out = language_id.predict(d, d.columns, language_id.fit(d))
    assert sorted(out.columns) == sorted(d.columns) and out.count() == len(rows)
    assert_untouched(spark, out, ("lang_pred", "score"))


def test_very_long_texts(spark):
    rng = random.Random(31)
    long_ = prose(rng, 80_000)
    made = [(1, long_), (2, long_[: len(long_) // 2] + "\n" * 5000 + "y" * 300_000), (3, "x" * 1_200_000), (4, None), (5, "short one")]
    d = docs(spark, made)
    cut = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(d).collect()}
    assert cut[3]["n_removed"] == 1_200_000 and cut[2]["n_removed"] >= len(long_) // 2 + 300_000 and cut[5]["n_removed"] == 0
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(d).collect()} == dict.fromkeys(range(1, 6), 0)
    pieces = packing.pack(d, BPE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in pieces) and len(pieces) == 5
    assert all(len(r["fingerprint"]) == 16 for r in simhash.simhash_components(d).collect())
    assert {r["doc_id"] for r in simhash.drop_near_copies(d).collect()} == set(range(1, 6))
    assert all(r["group_size"] == 1 for r in exact_dedup(d).collect())
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d).collect()}[4] == "und"


def test_span_emitter_without_repeats_in_a_chunk():
    rng = random.Random(41)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    blocks = []
    for rep, text in enumerate((passage + "".join(rng.choices("xyz", k=90)), passage + "".join(rng.choices("uvw", k=90)))):
        spans = [{"seed": -5, "lo": 0, "hi": 99, "rep": rep, "subs": 1}]
        blocks += suffix_dedup._emitter(3)(iter([pa.RecordBatch.from_pylist([{"text": text, "spans": spans}])]))  # each a task's last chunk
    assert all(b.num_rows == 1 for b in blocks)
    found = suffix_dedup._settle((0,), pa.Table.from_batches(blocks)).to_pydict()
    assert found["rep"] == [0, 1] and found["m0"] == [(1 << 60) - 1] * 2 and found["m1"] == [1] * 2


def test_leftmost_minimum():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(5, 120))
        w = int(rng.integers(1, n + 1))
        v = rng.integers(0, 5, n).astype(np.uint64)
        assert suffix_windows.leftmost_minimum(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(n - w + 1)]


# --- 3 ---

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    got = packing.pack(docs(spark, rows).coalesce(2), BPE, with_ids=True).collect()
    by_sequence, pieces = defaultdict(list), Counter()
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= 1024 and ends[-1] & (ends[-1] - 1) == 0
        assert {r["sequence_length"] for r in own} == {ends[-1]}
    unique = [(i, ids) for (i, ids), n in want.items() if n == 1 and sum(1 for j, _ in want if j == i) == 1]
    for i, ids in unique:
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert tuple(x for r in own for x in r["ids"]) == ids and [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
    assert sum(r["length"] for r in got) == sum(n * len(ids) for (_, ids), n in want.items())


def test_packer_tiers_and_steps():
    made = []
    p = packing.Packer(lambda tier, step, w: made.append((tier, step, w)), buffer=50)
    rng = np.random.default_rng(1)
    total = 0
    for k in range(400):
        n = int(rng.integers(1, 2500))
        total += n
        p.add(k, np.arange(n, dtype=np.int32))
    p.close()
    assert sum(len(x[2]) for _, _, w in made for x in w) == total and all(sum(len(x[2]) for x in w) == t for t, _, w in made)
    assert Counter(t for t, _, _ in made)[1024] > len(made) / 2
    per_step = defaultdict(int)
    for t, s, _ in made:
        per_step[s] += t
    assert max(per_step.values()) <= packing.STEP_TOKENS


def test_packing_special_tokens_and_pool(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    as_text = Tokenizer.from_file(BPE)
    as_text.encode_special_tokens = True
    text = "hello <|endoftext|> world"
    for special, t in ((True, plain), (False, as_text)):
        got = packing.pack(docs(spark, [(1, text)]), BPE, with_ids=True, special=special).orderBy("start").collect()
        assert [x for r in got for x in r["ids"]] == t.encode(text, add_special_tokens=False).ids + [0]
    rng = random.Random(2)
    pool = packing.token_pool(BPE)
    pool.limit = 30_000  # starts anew again and again
    for _ in range(8):
        texts = ["\n".join(prose(rng, 12) for _ in range(4)) for _ in range(20)]
        assert [x.tolist() for x in pool.encode_batch(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert pool.held < 200_000
    pool.limit = 96 << 20


def test_chunk_pool_keeps_what_many_texts_have():
    encoded = Counter()

    def encode(chunks):
        encoded.update(chunks)
        return [[len(c), *map(ord, c)] for c in chunks]

    pool = ChunkPool(encode, limit=60_000)
    want = lambda t: [x for k, w in enumerate(t.split(" ")) for c in [w if k == 0 else " " + w] for x in (len(c), *map(ord, c))]
    for k in range(60):
        texts = [f"start common words and one{k}x{j} more" for j in range(20)]
        assert [x.tolist() for x in pool.encode_batch(texts)] == [want(t) for t in texts]
        odd = ["two  spaces", "a\u00a0b common", "", "tab\tword"]  # whole texts, but for the empty one
        assert [x.tolist() for x in pool.encode_batch(odd)] == [[] if not t else [len(t), *map(ord, t)] for t in odd]
        assert pool.held < 90_000
    assert encoded[" common"] == encoded["start"] == 1 and encoded[" one0x0"] == 1


def test_step_groups_mix_tiers_evenly():
    made = []
    p = packing.Packer(lambda tier, step, w: made.append((tier, step)), buffer=100)
    rng = np.random.default_rng(3)
    for k in range(3000):
        p.add(k, np.arange(int(rng.integers(1, 900)), dtype=np.int32))
    p.close()
    per_step = defaultdict(int)
    for t, s in made:
        per_step[s] += t
    sizes = [per_step[s] for s in sorted(per_step)]
    assert sorted(per_step) == list(range(len(sizes))) and max(sizes) <= packing.STEP_TOKENS and min(sizes) > 0.3 * packing.STEP_TOKENS


def test_packing_empty(spark):
    assert packing.pack(docs(spark, []), BPE).count() == 0


# --- 4 ---


def test_language_id(spark):
    rng = random.Random(2)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["çağ", "ölü", "şu", "kız"], "cc": ["schiff", "zwölf", "straße", "bach"]}
    made = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 90))), lang, "s", 0) for k, lang in enumerate(rng.choice(list(words)) for _ in range(240))]
    made += [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "12 .,;", "bb", "s", 0), (1003, "lorem ipsum dolor amet lorem", None, "s", 0), (None, "lorem dolor amet ipsum", "aa", "s", 0)]
    df = spark.createDataFrame(made, SCHEMA).withColumn("label", F.lit(1)).withColumn("_n", F.lit(2))
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == len(made) and all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1000, 1001, 1002))
    held = [(k, lang) for k, _, lang, _, _ in made[:240] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(240)) and not got[None]["held_out"]
    assert sum(got[k]["lang_pred"] == lang for k, lang in held) / len(held) > 0.95 and got[1003]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 0)], SCHEMA)
    assert language_id.identify(df).first()["lang_pred"] == "und" and language_id.identify(df.where("false")).count() == 0


# --- 5 ---


def test_segment_bpe(spark, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    odd = ["a", "b", "é", " ", "\n", "\t", "1", "'s", ".", "  ", "\xa0", "漢", "😀", "\x1c", " ", "\r\n", "the", "\0"]
    more = rows + [(500 + k, "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))) for k in range(300)] + [(900, "ab" * 700 + "\n\n"), (901, "\n a"), (902, " a b")]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in segment_bpe.encode_documents(docs(spark, more), path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in more:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    bpe = segment_bpe.pooled(path, public_tokenizers.PATTERN)[0]
    for piece in (b"abcabcabc" * 7, b"hello world" * 30):
        assert bpe.merge_long(piece) == reference._encode_single_piece(piece)


# --- 6 ---


def test_token_rollup(spark, rows):
    d = docs(spark, rows)
    c = token_rollup.counted(d, BPE, "v1").persist()
    r = token_rollup.TokenRollup(spark, common.fresh_path(spark, "t"))
    assert r.totals().count() == 0
    assert r.commit("a", token_rollup.inserts(c)) and not r.commit("a", token_rollup.inserts(c))
    want = (len(rows), sum(x["n_tokens"] for x in c.collect()), sum(len((t or "").encode()) for _, t in rows))
    total = lambda: tuple(r.totals().agg(F.sum("n_docs"), F.sum("n_tokens"), F.sum("n_bytes")).first())
    assert total() == want
    r.compact()
    assert total() == want and not r.commit("a", token_rollup.inserts(c))
    r.commit("b", token_rollup.revisions(c, c.withColumn("tokenizer_version", F.lit("v2"))))
    assert [x["tokenizer_version"] for x in r.totals().collect()] == ["v2"] and total() == want
    r.commit("c", token_rollup.deletes(c.withColumn("tokenizer_version", F.lit("v2"))))
    r.compact()
    assert r.totals().count() == 0
    with pytest.raises(ValueError):
        r.commit("a/b", token_rollup.inserts(c))


def test_token_rollup_against_the_tokenizer(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    c = token_rollup.counted(docs(spark, rows), BPE, "v1", carried=["doc_id"]).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_bytes"], r["n_words"]) for r in c) == Counter((i, len(t.encode(x or "", add_special_tokens=False).ids), len((x or "").encode()), len((x or "").split())) for i, x in rows)


def test_token_rollup_query_and_commit_beside_compaction(spark, monkeypatch):
    from plumbline.llm import queries

    sf = "/root/testdata/sf0.001"
    whole = token_rollup.counted(spark.read.parquet(f"{sf}/documents.parquet"), BPE, "byte_bpe_50k-1")
    want = {tuple(r) for r in whole.groupBy("source", "lang", "tokenizer_version").agg(F.count("*"), F.sum("n_tokens"), F.sum("n_bytes")).collect()}
    got = queries.op6_token_rollup(spark, sf)
    assert {tuple(r) for r in got.select("source", "lang", "tokenizer_version", "n_docs", "n_tokens", "n_bytes").collect()} == want
    r = token_rollup.TokenRollup(spark, common.fresh_path(spark, "t"))
    one = spark.createDataFrame([("s", "en", "v", 1, 5, 9)], token_rollup.SCHEMA)
    r.commit("a", one)
    sums = r._sums

    def late(*args):  # a batch is committed after the listing
        r.commit("b", one)
        return sums(*args)

    monkeypatch.setattr(r, "_sums", late)
    r.compact()
    monkeypatch.undo()
    assert r.totals().first()["n_docs"] == 2
    r.compact()
    assert r.totals().first()["n_docs"] == 2 and not r.commit("a", one) and not r.commit("b", one)


# --- 7 ---


def plain_fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k in range(len(fps)):
        least[find(k)].append(ids[k])
    return [min((i for i in least[find(k)] if i is not None), default=None) for k in range(len(fps))]


def test_simhash(spark, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components([i for i, _ in rows], fps)
    want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps, strict=True))
    assert Counter(tuple(r) for r in simhash.simhash_components(docs(spark, rows)).collect()) == want
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_simhash_links_random_balls(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(12):  # chains and balls about random centers
        c = rng.getrandbits(64)
        for _ in range(8):
            fps.add(c)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                c ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df, len(fps))).collect()}
    signed = [simhash._signed(f) for f in fps]
    want = plain_components(signed, fps)
    assert [roots.get(s, s) for s in signed] == want


def test_simhash_pairs_by_distance():
    rng = random.Random(4)
    for d in range(1, 6):
        for _ in range(30):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            met = simhash.meetings(*simhash.variants(np.array([a, b], np.uint64)))
            assert (len(met[0]) > 0) == (d <= 3)


def test_drop_near_copies(spark, rows):
    kept = simhash.drop_near_copies(docs(spark, rows)).collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[0] == 1 and ids[10] == 0 and ids[20] == 0 and ids[None] == 2 and ids[23] == 1 and ids[24] == 0


def test_drop_near_copies_repeated_and_null_identifiers(spark):
    rng = random.Random(23)
    a, b, c = (prose(rng, 60) for _ in range(3))
    made = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, c), (None, c), (None, b + " x"), (5, None), (6, "")]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs(spark, made)).collect())
    assert got == Counter([(1, a), (2, b), (4, c), (None, c), (None, b + " x"), (5, None)])


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_drop_near_copies_reaches_similarity(spark):
    rng = random.Random(17)
    made, k = [], 0
    for _ in range(30):
        words = prose(rng, 200).split()
        for edits in (0, 1, 3, 4, 12):  # of 196 shingles an edit changes five
            for at in rng.sample(range(8, 192), edits):
                words[at] = f"new{k}x{at}"
            made.append((k, " ".join(words)))
            k += 1
    root = {i: i for i, _ in made}
    for i, a in made:
        for j, b in made[:i]:
            if jaccard(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {n: low if r == high else r for n, r in root.items()}
    want = {i for i, r in root.items() if i == r}
    assert len(want) < len(made) / 2
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, made)).collect()} == want


def test_near_copies_meet_in_balls_first(spark):
    rng = random.Random(29)
    made = []
    for k in range(40):
        words = prose(rng, 400).split()
        made += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "changed"]))]
    rows = near_copies._named(docs(spark, made).select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("u1"), F.lit(0).cast("long").alias("u2"), "text"))
    got = {(r["a"], r["b"]) for r in near_copies._balls(rows).collect()}
    at = {r["id"]: (r["node"], r["fp"]) for r in rows.collect()}
    within = lambda x, y: (at[x][1] ^ at[y][1]) & (2**64 - 1)
    want = {tuple(sorted((at[x][0], at[y][0]))) for x in at for y in range(x) if within(x, y).bit_count() <= 3}
    assert len(want) > 30 and got == want


def test_near_copies_of_one_text_are_not_met_in_pairs(spark, monkeypatch):
    rng = random.Random(31)
    base = prose(rng, 150).split()
    made = [(0, " ".join(base))]
    for k in range(1, 181):  # up to seven edits out of few: shingles of edits repeat; from four on an edited text is no near copy of the base
        words = list(base)
        for at in rng.sample(range(5, 145, 10), rng.choice((1, 2, 4, 5, 6, 7))):
            words[at] = f"new{rng.randrange(12)}"
        made.append((k, " ".join(words)))
    tested, written = [], common.written

    def counted(df, label, *more, **named):
        out = written(df, label, *more, **named)
        if label == "near-pairs":
            tested.append(out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    got = {r["id"]: r["component"] for r in near_copies.near_copies(docs(spark, made)).collect()}
    root = {i: i for i, _ in made}
    for i, a in made:
        for j, b in made[:i]:
            if jaccard(a, b) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {n: low if r == high else r for n, r in root.items()}
    classes = lambda named: {frozenset(i for i in named if named[i] == c) for c in named.values()}
    assert classes(got) == classes(root) and len(classes(root)) > 40
    assert sum(tested) < len(made) * (len(made) - 1) / 2 / 5


# --- 8 ---


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]


def plain_lines(rows):
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r\x0b\x0c"):
                first.setdefault(x, (*key(i), k))
    gone = {a for a in first if len(a) >= 16 and any(first[b] < first[a] and near(a, b) for b in first)}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        keep = [x for k, x in enumerate(parts) if not x.strip(" \t\r\x0b\x0c") or first[x] == (*key(i), k) and x not in gone]
        out.append((i, len(parts), len(parts) - len(keep), "\n".join(keep)))
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([2, 4, 9, 13, 14, 40])) for _ in range(12)] + ["a" * n for n in (15, 16, 17, 64, 65, 128, 129, 130)] + ["short", "", "  ", "x" * 20 + "é" + "y" * 60]

    def edited(x):
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randint(0, len(x))
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("abz é") + x[k:], x[:k] + rng.choice("abz é") + x[k + 1 :]])
        return x

    made = [(k, "\n".join(edited(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for k in range(40)] + [(100, None), (101, ""), (None, pool[0] + "\n" + pool[5])]
    got = line_dedup.line_dedup(docs(spark, made)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got) == plain_lines(made)


def test_line_dedup_reads_lines_cheaply(spark, monkeypatch):
    rng = random.Random(37)
    lines = [prose(rng, 12) for _ in range(400)]
    d = docs(spark, [(k, "\n".join([lines[k], " \t\r\x0b\x0c", " \u00a0", lines[200 + k], lines[0]])) for k in range(200)])
    met, lookup = [], common.lookup

    def counted(left, *more, **named):
        met.append(left.count())
        return lookup(left, *more, **named)

    monkeypatch.setattr(common, "lookup", counted)
    out = line_dedup.line_dedup(d)
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()} == {k: (1 if k == 0 else 2) for k in range(200)}
    assert met[-1] < 500  # of 800 lines that are not blank, those with a copy
    plan = line_dedup._lines(line_dedup._rows(d, "doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan  # every character of every text, where the first one tells


def test_line_dedup_deals_long_lines_out(spark, monkeypatch):
    rng = random.Random(41)
    lines = [prose(rng, 800) for _ in range(100)]
    d = docs(spark, list(enumerate(lines + [x[:1000] + "#" + x[1001:] for x in lines])))
    dealt, variants = [], line_dedup._variants

    def counted(near, carried):
        by_task = near.groupBy(F.spark_partition_id()).agg(F.sum(F.char_length("line")).alias("n"))
        dealt.append(max(r["n"] for r in by_task.collect()))
        return variants(near, carried)

    monkeypatch.setattr(line_dedup, "_variants", counted)
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(d).collect()} == {k: k // 100 for k in range(200)}
    assert sum(map(len, lines)) > 300_000 > max(dealt)  # one task had all 200 lines


def test_trimmed_gives_memory_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        blocks = [np.ones(12_000) for _ in range(2_000)]
        last.append(np.ones(12_000))  # above the others, so that they are not at the heap's end
        del blocks
        yield from batches

    last, before = [], held()
    assert list(common.trimmed(run)(iter([1, 2]))) == [1, 2]
    assert held() - before < 50e6  # 192 MB were in use and stayed


def test_line_dedup_edges(spark):
    d = docs(spark, [])
    assert line_dedup.line_dedup(d).count() == 0
    long_ = "w" * 30_000
    rows = [(1, long_), (2, long_[:-1] + "v"), (3, long_ + "x"), (4, "one two three four"), (4, "one two three four")]
    got = {(r["doc_id"]): r["n_dropped"] for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


# --- 9 ---


def test_fingerprints(spark, rows, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_ROWS", 4)
    made = [r for r in rows if r[0] is not None and r[0] != 20]
    got = {r["doc_id"]: r for r in sketch.fingerprints(docs(spark, made)).collect()}
    order = sorted(made)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[10]["fingerprint"] and got[0]["near_edited"] > 0.4 and got[23]["fingerprint"] == got[24]["fingerprint"] and got[23]["near_next"] == 1
    assert got[13]["fingerprint"] == "" and got[12]["near_edited"] == 1.0


def test_fingerprints_repeats_and_empty(spark, rows):
    assert sketch.fingerprints(docs(spark, rows)).count() == len(rows)
    assert sketch.fingerprints(docs(spark, [])).count() == 0


def test_sketch_merge_and_containment(spark):
    rng = random.Random(8)
    a, b = prose(rng, 3000), prose(rng, 3000)
    df = spark.createDataFrame([(a, b, a[: len(a) // 2])], "a string, b string, half string")
    s = {c: sketch.sketch(F.col(c)) for c in ("a", "b", "half")}
    r = df.select(sketch.contained(s["half"], s["a"]).alias("half"), sketch.contained(s["a"], s["half"]).alias("whole"), sketch.contained(s["a"], sketch.merged(s["a"], s["b"])).alias("merged"), sketch.likeness(s["a"], s["b"]).alias("no"),
                  (sketch.decoded(sketch.encoded(s["a"])) == s["a"]).alias("same")).first()
    assert r["half"] > 0.98 and 0.4 < r["whole"] < 0.6 and r["merged"] == 1 and r["no"] < 0.05 and r["same"]


def plain_sketch(hashes, scale=sketch.SCALE, least=sketch.LEAST):
    low = sorted({h for h in hashes if h < -(2**63) + 2**64 // scale})
    return low if len(low) >= least else sorted(set(hashes))[:least]


def plain_likeness(a, b, scale=sketch.SCALE, least=sketch.LEAST):
    if not a or not b:
        return float(len(a) == len(b))
    limit = min(2**63 - 1 if len(s) < least else max(s[-1], -(2**63) + 2**64 // scale - 1) for s in (a, b))
    a, b = ({x for x in s if x <= limit} for s in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def test_fingerprints_against_plain(spark, rows, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_ROWS", 3)
    made = [r for r in rows if r[0] is not None and r[0] != 20]
    order = sorted(made)
    texts = {i: t or "" for i, t in order}
    edited = {i: texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[order[(k + 1) % len(order)][0]][: len(texts[i]) // 4] for k, (i, _) in enumerate(order)}
    hashed = spark.createDataFrame([(i, texts[i], edited[i]) for i in texts], "i long, t string, e string").select("i", *[sketch.shingle_hashes(F.col(c)).alias(c) for c in "te"]).collect()
    own, changed = {r["i"]: plain_sketch(r["t"]) for r in hashed}, {r["i"]: plain_sketch(r["e"]) for r in hashed}
    hexed = lambda s: "".join(f"{x % 2**64:016x}" for x in s)
    for frame in (docs(spark, made), docs(spark, made).withColumn("doc_id", F.format_string("%05d", F.col("doc_id") + 100))):
        got = {int(r["doc_id"]) - 100 * isinstance(r["doc_id"], str): r for r in sketch.fingerprints(frame).collect()}
        assert len(got) == len(order)
        for k, (i, _) in enumerate(order):
            r, nxt = got[i], order[(k + 1) % len(order)][0]
            assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(own[i]), hexed(changed[i]))
            assert (r["near_edited"], r["near_next"]) == pytest.approx((plain_likeness(own[i], changed[i]), plain_likeness(own[i], own[nxt])))


def test_sketch_merges_exactly(spark):
    rng = random.Random(12)
    for n in (3, 30, 400):
        a, b = prose(rng, n), prose(rng, n // 2 + 1)
        df = spark.createDataFrame([(a, b)], "a string, b string")
        both = sketch._retained(F.concat(sketch.shingle_hashes(F.col("a")), sketch.shingle_hashes(F.col("b"))), sketch.SCALE, sketch.LEAST)
        r = df.select(sketch.merged(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m"), both.alias("both")).first()
        assert r["m"] == r["both"]


# --- 10 ---


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("idx", F.lit("clash")).withColumn("hash", F.lit("clash"))


def test_warc_records(spark):
    r = pages(spark, [(1, "http://a", "<p>é</p>"), (2, None, None)]).select(warc.record(F.col("url"), F.col("html")).alias("d")).select("d", warc.parse(F.col("d")).alias("p")).collect()
    assert r[0]["p"]["payload"] == "<p>é</p>" and r[0]["p"]["url"] == "http://a" and all(x["p"]["digest_ok"] for x in r) and r[1]["p"]["payload"] == ""
    assert bytes(r[0]["d"]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(r[0]["d"]).endswith(b"\r\n\r\n")


def test_warc_files_read_by_offset(spark):
    rows = [(k, f"http://h/{k}", "<p>" + "é\r\n\r\n" * k + "</p>") for k in range(2100)] + [(None, None, None), (None, "u", "x"), (5, "again", "y")]
    p = pages(spark, rows)
    path = common.fresh_path(spark, "w")
    warc.write_files(p, path)
    found = warc.read_records(spark, path, warc.laid_out(p)).withColumn("p", warc.parse(F.col("data"))).select("page_id", "p.*", (F.sha2("data", 256)).alias("h")).collect()
    assert Counter((r["page_id"], r["url"], r["payload"], r["digest_ok"]) for r in found) == Counter((i, u or "", h or "", True) for i, u, h in rows)
    assert Counter(r["h"] for r in found) == Counter(r["hash"] for r in warc.laid_out(p).collect())
    broken = spark.sql("SELECT unhex(hex('WARC/1.1\r\nWARC-Target-URI: http://x\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\n') || 'ff41fe' || '0d0a0d0a') AS d").select(warc.parse(F.col("d")).alias("p")).first()["p"]
    assert broken["url"] == "http://x" and "A" in broken["payload"] and broken["digest_ok"] is False


def test_warc_files_are_deflated_fast(spark, tmp_path):
    rng = random.Random(41)
    p = pages(spark, [(k, f"http://h/{k}", prose(rng, 2_000)) for k in range(50)]).coalesce(1)
    warc.write_files(p, str(tmp_path / "w"))
    (path,) = (tmp_path / "w" / "file_no=0").glob("*.gz")
    data = path.read_bytes()
    plain = gzip.decompress(data)
    assert plain.count(b"WARC-Type: response") == 50
    assert len(data) > (len(gzip.compress(plain, 1)) + len(gzip.compress(plain, 6))) / 2  # level 1's size, not the default's


def test_warc_file_without_legible_list(spark, tmp_path):
    lists = ["WARC/1.1 cut short", warc.INDEX_HEAD + "Content-Length: 5" + warc.END + "x 0 4"]
    for i, text in enumerate(lists):
        (tmp_path / f"file_no={i}").mkdir()
        (tmp_path / f"file_no={i}" / "part.txt").write_bytes((text + warc.END).encode())
    assert [r["data"] for r in warc.cut_records(spark, str(tmp_path)).collect() if r["idx"] is not None] == []


def test_warc_audit(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 40)
    monkeypatch.setattr(warc, "FANOUT", 3)
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(150)] + [(None, "u", "n"), (7, "again", "x")]
    a = pages(spark, rows)
    bad = {5, 44, 149}
    b = a.withColumn("html", F.when(F.col("page_id").isin(list(bad)), F.lit("!")).otherwise(F.col("html")))
    found = warc.fixity(a, b).collect()
    assert len(found) == len(rows) and {r["page_id"] for r in found if r["finding"] == "differs"} == bad
    assert {r["finding"] for r in warc.fixity(a, a).collect()} == {"ok"}
    cut = warc.fixity(a, a.where("page_id IS NULL OR page_id < 149")).collect()
    assert [(r["page_id"], r["finding"]) for r in cut if r["finding"] != "ok"] == [(149, "missing in b")]
    assert warc.fixity(a.where("false"), a.where("false")).count() == 0


def test_warc_audit_missing_inside_and_negative(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 40)
    monkeypatch.setattr(warc, "FANOUT", 3)
    a = pages(spark, [(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(-500, 90) if k != 50] + [(None, "u", "n")])
    b = pages(spark, [(k, f"http://h/{k}", "!" if k in (-450, 60) else f"<p>{k}</p>") for k in range(-500, 90) if k != 45] + [(None, "u", "n")])
    found = warc.fixity(a, b).collect()
    assert {(r["page_id"], r["finding"]) for r in found if r["finding"] != "ok"} == {(-450, "differs"), (60, "differs"), (45, "missing in b"), (50, "missing in a")}
    assert len(found) == 591


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    made = [(k, prose(rng, rng.randint(30, 400)), "en", "s", 0) for k in range(40)]
    made += [(50, None, "en", "s", 0), (51, "12 34", "en", "s", 0), (52, made[3][1], "en", "s", 0), (53, made[4][1] + " tail", "en", "s", 0), (54, "Ein Satz. " * 40, "de", "s", 0)]
    spark.createDataFrame(made, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = common.written(stage(spark, d, str(tmp_path)), name)
        assert d.columns == corpus_pipeline.COLUMNS
        sizes.append({r["doc_id"] for r in d.select("doc_id").collect()})
    assert not {50, 51} & sizes[0] and len(sizes[0]) == 43 and sizes[1] == sizes[0] - {52}  # 52 is a copy: no line of it is left
    clean = {k for k in range(40)} - {3, 4}
    assert clean | {3, 4} <= sizes[3]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and {r["doc_id"] for r in out.collect()} == sizes[3]


def test_pipeline_language_stage_rejects(spark):
    import corpus_pipeline

    rng = random.Random(3)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["çağ", "ölü", "şu", "kız"], "cc": ["schiff", "zwölf", "straße", "bach"]}
    say = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    clean = [(k, say(lang), lang, "s", 9) for k in range(1500) for lang in [rng.choice(list(words))]]
    wrong = [(1800 + k, say("aa"), "bb", "s", 9) for k in range(4)]
    other = [(2000, say("cc"), None, "s", 9), (2001, say("cc"), "zz", "s", 9), (2002, "12 ,", "aa", "s", 9), (2003, None, "aa", "s", 9)]
    keep = lambda rows: {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert keep(clean + wrong + other) == set(range(1500)) | {2000, 2001}
    blank = [(i, t, None, s, n) for i, t, _, s, n in clean[:20] + other]
    assert keep(blank) == set(range(20)) | {2000, 2001}
