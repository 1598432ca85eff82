"""Importance resampling, merge-type pieces and collocations against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from ledgerflow.llm import collocations, importance, pieces, queries

SF = "/root/testdata/sf0.001"
NASTY = [None, "", "   \n\t ", "one", "A a, b; a A!", "x " * 40, "é " * 30 + "　日本 😀", "▁ ▁▁a ▁", "a" * 3000, "tie tie tie\ntie tie", "word" + "\x00\x1f" + "9"]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(-k - 1, t, None if k % 2 else "en", None, None) for k, t in enumerate(NASTY)] + [(None, "null id of twenty words " * 5, "en", "s", 7)] * 2
    rows += [(900_000, "the very long one is here again and again, " * 4000, "xx", "s", 1)] + [(900_000 + k, "equal scores " * 10, "en", "s", 1) for k in (1, 1, 2)]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    return base.unionByName(spark.createDataFrame(rows, base.schema)).selectExpr("*", "1 as rank", "'x' as score", "2 as f", "3 as phrase", "4 as `part.x`").cache()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_resampling(rows, target):
    """Rows (doc_id, n_features, weight, score) and the drawn ones in order, by strings and zlib."""

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), Counter(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))

    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s, t = Counter(), Counter()
    found = [(i, *features(x)) for i, x in rows]
    for counts, texts in ((s, [f for *_, f in found]), (t, [features(x)[1] for x in target])):
        for f in texts:
            for x, n in f.items():
                counts[bucket(x)] += n
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] * k for x, k in f.items())
        out.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    return out, can[: 5 * len(can) // 100]


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_importance(spark, docs, block, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", block)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    target = target.unionByName(spark.createDataFrame([(None, None), (1, "")], target.schema))
    few = docs if block > 7 else docs.where("doc_id < 60 and length(text) < 5000 or text is null")
    rows = [(r["doc_id"], r["text"]) for r in few.select("doc_id", "text").collect()]
    want, drawn = plain_resampling(rows, [r["text"] for r in target.collect()])
    got = importance.resampled(few, target).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter((i, f, w, s) for i, _, f, w, s in want)
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(x[0], x[4]) for x in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1)) and len(drawn)


def test_importance_by_sql(spark, tmp_path, docs):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op11_importance_resampling"])
    got = queries.op11_importance_resampling(spark, str(tmp_path))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_importance_of_nothing(spark, docs):
    none = spark.read.parquet(f"{SF}/benchmark.parquet").limit(0)
    assert importance.resampled(docs.limit(0), none).count() == 0
    assert importance.resampled(docs.where("text is null"), none).select("n_features", "weight", "rank").first() == (0, 0, None)
    assert all(r["rank"] is None or r["rank"] > 0 for r in importance.resampled(docs, none).collect())


def test_carried_crc():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.bytes(rng.integers(0, 40)), rng.bytes(rng.integers(0, 3000))
        assert int(importance.carried(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.fixture(scope="module")
def model():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.PieceCoder(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_of_rows(spark, docs, model):
    path = public_tokenizers.path("piece_bpe_32k.model")
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = model[1].encode(r["text"] or "", add_eos=True)
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model[1].decode(ids).encode()).hexdigest())] += 1
    assert Counter(map(tuple, pieces.piece_digests(docs, path).collect())) == want
    again = pieces.encode(docs, path)
    assert Counter((r["doc_id"], r["decoded"]) for r in again.collect()) == Counter((r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in docs.select("doc_id", "text").collect())
    assert pieces.piece_digests(docs.limit(0), path).count() == 0


def test_pieces_of_mixed_strings(model):
    """Strings that make merging hard: joined pieces, runs, few letters, all of Unicode."""
    own, library = model
    rng = random.Random(5)
    names, few = list(own.ids), "aabcdeè ▁\n.0中😀"
    texts = ["".join(rng.choice(few) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["".join(rng.choice(names).replace("▁", rng.choice([" ", ""])) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(300)]
    texts += [c * n for c in ("a", "=", " ", "ab", "-", "é", "▁", "\n") for n in (1, 2, 7, 64, 1001)]
    got = [x.tolist() for x in own.rows(pa.array(texts))]
    assert got == [library.encode(t, add_eos=True) for t in texts] and got[:50] == [own.encode(t) for t in texts[:50]]
    assert [own.decode(np.array(x)).decode() for x in got] == [library.decode(x) for x in got]


def test_pieces_take_back(model):
    """Some texts need a longest piece taken back, and cuts agree with plain merging."""
    own, _ = model
    rng, greedy = random.Random(2), 0
    for _ in range(400):
        text = "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 24)))
        cut = own.cut(text)
        assert cut == own.merged(text)
        longest = next(text[:k] for k in range(len(text), 0, -1) if k == 1 or text[:k] in own.ids)
        greedy += cut[0] != longest
    assert greedy > 10


def plain_collocations(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {x for x in c if len(x) > 1 and c[x] >= least}
        gone = {y[i : i + 2] for y in cand if len(y) == 3 for i in (0, 1) if 100 * c[y] >= share * c[y[i : i + 2]]}
        scored = []
        for x in cand - gone:
            s, _, l, r = min((10**6 * c[x] ** 2 // (c[x[:k]] * c[x[k:]]), k, c[x[:k]], c[x[k:]]) for k in range(1, len(x)))
            scored.append((-s, -c[x], " ".join(x).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_collocations(spark, docs, shard, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", shard)
    few = docs if shard > 50 else docs.where("length(text) < 3000")
    got = sorted(map(tuple, collocations.collocations(few, least=4 if shard == 50 else 10).collect()))
    assert got == plain_collocations([(r["lang"], r["text"]) for r in few.select("lang", "text").collect()], 4 if shard == 50 else 10) and got


def test_collocations_by_sql(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op13_collocations"])
    got = queries.op13_collocations(spark, str(tmp_path))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_collocations_of_edges(spark):
    """At the least count and not under it; a longer candidate at just the share; ties of score and count by bytes; numbers beyond 64 bits."""
    rows = [("en", "a b c. " * 10 + "a b. " * 10 + "z y. " * 9 + "é f. é g. " * 10 + "n m. n m. " * 10)]
    d = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, collocations.collocations(d).collect()))
    assert got == plain_collocations(rows) and {"z y", "a b", "b c"} & {r[2] for r in got} == set() and "a b c" in {r[2] for r in got}
    assert collocations.collocations(d, share=51).where("phrase = 'a b'").count() == 1
    assert collocations.collocations(d, top=2).count() == 2 and collocations.collocations(d.limit(0)).count() == 0
    big = spark.createDataFrame([("en", "x y", 2, 3 * 10**12), ("en", "x", 1, 7 * 10**12), ("en", "y", 1, 5 * 10**12)], "lang string, phrase string, size int, f long")
    assert collocations.scored(big).first()["score"] == 10**6 * (3 * 10**12) ** 2 // (35 * 10**24)


def test_suffix_arrays_by_sorting():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 40, 300):
        words, piece = rng.integers(0, 4, n), np.cumsum(rng.random(n) < 0.2)
        left = [words[i : i + 3][piece[i : i + 3] == piece[i]].tolist() for i in range(n)]
        order = collocations.suffix_array(words, piece, 3)
        assert [left[i] for i in order] == sorted(left)
        shared, room = collocations.prefixes(words, piece, order, 3)
        for depth in (1, 2, 3):
            first, count = collocations.intervals(shared, room, depth)
            assert {tuple(left[order[a]][:depth]): c for a, c in zip(first, count.tolist(), strict=True)} == Counter(tuple(x[:depth]) for x in left if len(x) >= depth)
