"""Each operator against a brute-force version, on the smallest tables and on odd rows."""

import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phasegrid.llm import mixing, ngram_join, packing, pii, quality_model, quality_rules, registry, sharding, topk_search, url_filter, warc
from phasegrid.llm.common import gapless_rank, new_path, stored, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " \t\n ", "one", "a b c d", "a b c d", "Ünï çødé", "x" * 5000, "w " * 3000, "line\nline\nline two\n", "same text here for all of us", "same text here for all of us", "é😀 mixed 12 <b> %%%"]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, set_id long, n int, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, null ids and sources, and columns that clash with names used inside."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", "en", 0, 7, 1, "r") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[10], (None, "a b c d e f", "s1", "en", 0, 7, 1, "r"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_registry_names_all():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()}) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


# 1 ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, compression):
    big = "é" + "p" * 2000
    rows = [(1, "http://a/\r\nX: y", big), (5, None, big), (3, "http://b", big), (2, "u", None), (4, "u", "short"), (6, "u", "short"), (None, "n", big), (7, "u", "WARC/1.1\r\n\r\nWARC-Type: fake\r\n\r\n" * 50), (7, "u", "WARC/1.1\r\n\r\nWARC-Type: fake\r\n\r\n" * 50)]
    path = new_path(spark, "t")
    warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, compression=compression)
    back = warc.read_warc(spark, path).filter("record_type IN ('response', 'revisit')").collect()
    got = Counter((r.headers.get("x-page-id"), r.record_type, bytes(r.payload).decode() if r.payload is not None else None, r.headers.get("x-refers-to-page-id")) for r in back)
    fake = rows[-1][2]
    assert got == Counter({("5", "response", big, None): 1, ("1", "revisit", None, "5"): 1, ("3", "revisit", None, "5"): 1, (None, "revisit", None, "5"): 1, ("2", "response", "", None): 1, ("4", "response", "short", None): 1, ("6", "response", "short", None): 1, ("7", "response", fake, None): 2})
    light = warc.read_warc(spark, path, payload=False).filter((F.col("record_type") == "revisit") & F.col("refers_to").startswith("<urn:page:5"))
    assert light.count() == 3 and light.filter("payload IS NOT NULL").count() == 0
    assert warc.read_warc(spark, path).filter("target_uri IS NULL AND record_type = 'response'").count() == 1


def test_warc_reader_pushes_header_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructField, StructType

    r = warc.WarcReader({"path": "/tmp/none"}, StructType([StructField("record_type", __import__("pyspark").sql.types.StringType())]))
    left = list(r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and r.passes({"warc-type": "response"}) and not r.passes({"warc-type": "revisit"})


def test_warc_empty(spark):
    path = new_path(spark, "t")
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_appends_keep_earlier_records(spark):
    path = new_path(spark, "t")
    long = "é" * 1_500_000
    for lo, hi in ((0, 10), (10, 250)):
        warc.archive_pages(spark.createDataFrame([(i, "u", long if i == 5 else f"page {i}", 1) for i in range(lo, hi)], "page_id long, url string, html string, digest int"), path)
    back = warc.read_warc(spark, path).filter("record_type = 'response'")
    assert sorted(int(r.i) for r in back.select(F.col("headers")["x-page-id"].alias("i")).collect()) == list(range(250))
    assert back.filter(F.octet_length("payload") == 3_000_000).count() == 1


# 2 ------------------------------------------------------------------------------------------------------------
def brute_sets(rows):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_components(rows):
    sets, parent = brute_sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    for i, s in enumerate(sets):
        for j, o in Counter(j for g in s for j in held[g] if j < i).items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def check_join(df):
    members, _ = ngram_join.near_duplicates(df)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.labelled(members).collect())
    assert got == brute_components([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_ngram_join_equals_brute_force(docs, odd):
    check_join(docs)
    check_join(odd.withColumn("component", F.lit(1)).withColumn("th", F.lit(2)))


@pytest.mark.parametrize("short,common,rows", [(2, 2, 0), (2, 2, 1024), (3, 4, 0)])
def test_ngram_join_long_lists(spark, monkeypatch, short, common, rows):
    """A group of near copies that only partly link, through pivots and through all pairs of what is left."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", rows)
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for k in range(60):
        w = list(base)
        for p in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            w[p] = f"x{k}_{p}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:30] + [f"y{k}_{i}" for i in range(40)]) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, _ = ngram_join.near_duplicates(df, common=common)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.labelled(members).collect())
    assert got == brute_components(list(enumerate(texts)))


def test_ngram_join_empty(empty):
    members, links = ngram_join.near_duplicates(empty)
    assert members.count() == 0 and links.count() == 0


# 3 ------------------------------------------------------------------------------------------------------------
def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    rep = len({p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep


def brute_features(words):
    h = [xxhash.xxh64(w.encode(), 42).intdigest() for w in words]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    pair = lambda x, y: signed(xxhash.xxh64(y.to_bytes(8, "little"), xxhash.xxh64(x.to_bytes(8, "little"), 42).intdigest()).intdigest())
    end = lambda w: signed(xxhash.xxh64(w[-quality_rules.END :].encode(), xxhash.xxh64(quality_rules.END.to_bytes(4, "little"), 42).intdigest()).intdigest())
    ends = [quality_rules.WORD_BUCKETS + end(w) % quality_rules.END_BUCKETS for w in words]
    return [signed(x) % quality_rules.WORD_BUCKETS for x in h] + ends + [quality_rules.BLOCKS[2][0] + pair(x, y) % quality_rules.PAIR_BUCKETS for x, y in itertools.pairwise(h)]


def test_quality_rules(spark, docs, odd):
    labels = table(spark, SF, "labels")
    for df in (docs, odd):
        rows = quality_rules.quality_rules(df, labels).collect()
        texts = Counter((r.doc_id, r.text) for r in df.collect())
        assert Counter((r.doc_id, r.text) for r in rows) == texts
        for r in rows:
            want = brute_base(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).filter("NOT base_failed").collect() if r.doc_id in truth}
    assert all(k == bool(truth[i]) for i, k in kept.items()) and len(kept) > 30


def test_likelihood_ratio_equals_brute_force(spark, docs):
    trusted = spark.createDataFrame(quality_rules.trusted_ids(table(spark, SF, "labels")).collect(), "doc_id long")
    ids = {r[0] for r in trusted.collect()}
    few = docs.limit(60).select("doc_id", "text")
    got = quality_rules.log_ratios(few, trusted)
    raw, goal, each = Counter(), Counter(), {}
    for r in few.collect():
        each[r.doc_id] = WORD.findall(r.text or "")
        raw.update(brute_features(each[r.doc_id]))
        if r.doc_id in ids:
            goal.update(brute_features(each[r.doc_id]))
    for lo, hi in quality_rules.BLOCKS:
        n, m, b = sum(raw[k] for k in range(lo, hi)), sum(goal[k] for k in range(lo, hi)), hi - lo
        for k in range(lo, hi):
            share = (raw[k] + 1) / (n + b)
            assert math.isclose(got[k], math.log((goal[k] + 10 * share * b) / (m + 10 * b) / share), rel_tol=1e-9, abs_tol=1e-12)
    score = few.select("doc_id", quality_rules.word_hashes(F.col("text")).alias("g")).select("doc_id", quality_rules.likelihood_score(F.col("g"), got).alias("s"))
    for r in score.collect():
        w = each[r.doc_id]
        assert abs(r.s - (sum(got[k] for k in brute_features(w)) / len(w) if w else 0.0)) < 1e-5


def test_likelihood_depends_on_the_order_of_words(spark, docs):
    labels = table(spark, SF, "labels")
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").filter("size(split(text, ' ')) > 100").select("doc_id", "text")
    mixed = good.select("doc_id", F.array_join(F.array_sort(F.split("text", " ")), " ").alias("text"))
    ratios = quality_rules.log_ratios(docs, quality_rules.trusted_ids(labels))
    scores = lambda df: {r.doc_id: r.s for r in df.select("doc_id", quality_rules.word_hashes(F.col("text")).alias("g")).select("doc_id", quality_rules.likelihood_score(F.col("g"), ratios).alias("s")).collect()}
    own, other = scores(good), scores(mixed)
    gain = np.array([own[i] - other[i] for i in own])
    # of the same words, each document against itself: many standard errors above zero
    assert len(gain) > 20 and gain.mean() > 5 * gain.std() / math.sqrt(len(gain))


def test_quality_rules_clashing_columns_and_long_text(spark):
    rows = [(1, "a b c " * 200000, "w", "g", "row", 5), (2, None, "w", "g", "row", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _w string, g string, row string, n_words int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, table(spark, SF, "labels")).drop("text").collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed, got[1].g, got[1]._w, got[1].row) == (600000, 600000, True, "g", "w", "row")
    assert got[2].n_words == 0 and not got[2].kept


def test_quality_rules_without_labels(empty, odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(empty, none).count() == 0
    assert quality_rules.quality_rules(odd, none).filter("kept = base_failed").count() == 0


def test_quality_rules_count_every_trusted_document(spark):
    """No bound on trusted rows: ids whose hashes are the largest of 60,000 count, too."""
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    last = [r[0] for r in labels.orderBy(F.xxhash64("doc_id").desc(), F.col("doc_id").desc()).limit(40).collect()]
    assert quality_rules.trusted_ids(labels).count() == 60_000
    good = [(i, " ".join(f"good{(i * 7 + k) % 60}" for k in range(60))) for i in last]
    docs = spark.createDataFrame(good + [(100_000, "other words " * 40)], "doc_id long, text string")
    ratios = quality_rules.log_ratios(docs, quality_rules.trusted_ids(labels))
    assert max(ratios) > 0.0 and min(ratios) < 0.0  # without trusted rows all are 0
    assert all(r.kept for r in quality_rules.quality_rules(docs, labels).filter("doc_id < 100000").collect())
    assert quality_rules.quality_rules(docs, labels, keep=["doc_id"]).columns[0] == "doc_id"


# 4 ------------------------------------------------------------------------------------------------------------
def test_capacity_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes, k = rng.integers(0, 50, rng.integers(1, 12)).tolist(), int(rng.integers(1, 5))

        def fits(c):
            n, left = 1, c
            for s in sizes:  # noqa: B023
                if s > c:
                    return False
                if s > left:
                    n, left = n + 1, c
                left -= s
            return n <= k  # noqa: B023

        want = next(c for c in range(sum(sizes) + 1) if fits(c))
        assert sharding.capacity(sizes, k) == want
        at = sharding.cuts(sizes, k)
        assert at[0] == 0 and at[-1] == len(sizes) and len(at) == k + 1
        assert max(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False)) == want


def test_sharding(docs, odd, empty):
    for df in (docs, odd):
        rows, texts = sharding.shard_documents(df, 4).collect(), [tuple(r) for r in df.select("doc_id", "text").collect()]
        body = lambda t: (t or "").encode()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(body(t)) + 1, zlib.crc32(body(t))) for i, t in texts)
        for s in range(4):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        where = defaultdict(set)
        for r in rows:
            where[r.text_crc32, r.size].add(r.shard)
        assert all(len(v) == 1 for v in where.values())
    sums = Counter()
    for r in sharding.shard_documents(docs, 4).collect():
        sums[r.shard] += r.size
    largest = docs.select(F.max(F.octet_length("text"))).first()[0]
    assert max(sums.values()) - min(sums.values()) <= 2 * largest
    assert sharding.shard_documents(empty, 4).count() == 0


def test_gapless_rank_slices_hot_keys(spark):
    df = stored(spark.range(5000).selectExpr("cast(if(id % 3 = 0, 0, id % 7) as int) k", "id"), "t")
    got = defaultdict(list)
    for r in gapless_rank(df, "k", ["id"], "r").collect():
        got[r.k].append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


# 5 ------------------------------------------------------------------------------------------------------------
def test_quality_classifier_held_out_accuracy(spark):
    """No label takes part in the fit, so all of them are held out."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out, learned = quality_model.classify(docs)
    truth = out.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").select("quality", "quality_kept").collect()
    assert sum(r.quality_kept for r in truth if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in truth)
    assert sum(not r.quality_kept for r in truth if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in truth)
    assert 0.5 < learned["good_share"] < 1 and set(learned["accuracy"]) == set(quality_model.LABELLERS)


def test_em_recovers_simulated_accuracies():
    """Both accuracies of every labeller, each its own, and the share of good texts; labellers abstain at random."""
    rng = np.random.default_rng(3)
    k, n = len(quality_model.LABELLERS), 100_000
    on_good, on_bad = np.linspace(0.9, 0.99, k), np.linspace(0.35, 0.75, k)
    good = rng.random(n) < 0.8
    right = rng.random((n, k)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(rng.random((n, k)) < 0.1, 2, np.where(right == good[:, None], 1, 0))
    pattern = (votes * 3 ** np.arange(k)).sum(1).tolist()
    post, accuracy, prior = quality_model.estimate_accuracies(dict(Counter(pattern)))
    assert np.abs(accuracy[:, 0] - on_good).max() < 0.02 and np.abs(accuracy[:, 1] - on_bad).max() < 0.03 and abs(prior - 0.8) < 0.02
    assert ((np.array([post[p] for p in pattern]) > 0.5) == good).mean() > 0.9


def brute_votes(t):
    """The labellers' votes by plain string work."""
    b = (t or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    lower, upper, digit = (lambda c, r=r: c in r for r in (range(97, 123), range(65, 91), range(48, 58)))
    symbol = lambda c: c in b"#*$%&|<>~^=_@\\{}"
    mark = lambda c: 33 <= c < 127 and not (lower(c) or upper(c) or digit(c))
    n, some = len(words), len(words) >= 10
    m = max(n, 1)
    chars = max(1, sum(lower(c) or upper(c) or digit(c) or mark(c) or c >= 128 for c in b))
    letters = max(1, sum(lower(c) or upper(c) for c in b))
    letter = lambda c: lower(c) or upper(c) or c >= 128
    again = sum(v - 1 for v in Counter(words).values())
    values = [
        (sum(map(symbol, b)) / chars, 0.02, 0.08, some), (sum(map(upper, b)) / letters, 0.15, 0.5, some), (sum(x == y for x, y in itertools.pairwise(words)) / m, 0.05, 0.3, some),
        (sum(len(w) == 1 and (mark(w[0]) or w[0] >= 128) for w in words) / m, 0.05, 0.2, some), (abs(sum(map(len, words)) / m - 6.5), 3.5, 12.0, some),
        (sum(c in b"!?" for c in b) / m, 0.1, 0.4, some), ((b.count(b"\n") + 1) / m, 0.2, 0.7, some), (again / m, 0.65, 0.85, some and 30 <= n <= 5000),
        (1 - sum(all(letter(c) for c in (w[:-1] or w)) for w in words) / m, 0.1, 0.4, some),
    ]
    return sum((2 if not sure else 1 if x <= lo + 1e-12 else 0 if x >= hi - 1e-12 else 2) * 3**i for i, (x, lo, hi, sure) in enumerate(values))


def test_votes_and_posteriors_equal_brute_force(spark, docs, odd):
    for df in (docs, odd):
        rows = quality_model.classify(df)[0].select("text", "weak_votes", "weak_posterior", "quality_score").collect()
        assert [r.weak_votes for r in rows] == [brute_votes(r.text) for r in rows]
        post, _, _ = quality_model.estimate_accuracies(dict(Counter(r.weak_votes for r in rows)))
        assert all(math.isclose(r.weak_posterior, post[r.weak_votes], rel_tol=1e-12) for r in rows)
        assert len({(r.text, r.quality_score) for r in rows}) == len({r.text for r in rows})


def test_quality_fitting_sample_is_of_distinct_texts(spark, monkeypatch):
    """Copies take no place in the fitting sample: all 41 bad texts are in it, and as many good ones as there is room for."""
    fitted = []
    fit = quality_model.fit_scorer
    monkeypatch.setattr(quality_model, "fit_scorer", lambda bags, post: fitted.append((bags, post)) or fit(bags, post))
    words = lambda i: " ".join("plain sentence about rivers mountains valleys forests winter morning travel".split()[i % 10 :] + ["and", chr(97 + i // 26) + chr(97 + i % 26), "people", "walked", "slowly", "towards", "their", "little", "village", "again"])
    bad = ["### $$$ %%% *** @@@ " * 4 + "w" * (i + 1) for i in range(41)]
    texts = [bad[0]] * 800 + bad[1:] + [words(i) for i in range(200)]
    quality_model.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fit_rows=100)
    (bags, post), = fitted
    assert len(set(bags)) == len(bags) == 91 and int((post < 0.5).sum()) == 41


def test_quality_classifier_odd_rows(odd, empty):
    out, _ = quality_model.classify(odd)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in odd.collect())
    assert out.filter("text IS NULL AND quality_kept").count() == 0
    assert set(odd.columns) < set(out.columns) and quality_model.classify(empty)[0].count() == 0


# 6 ------------------------------------------------------------------------------------------------------------
def check_pack(rows, limit=4096):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= limit
    return len(seqs)


def test_pieces_are_the_same_whatever_is_remembered(docs):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(packing.pieces(docs, 300, remember=20)) == key(packing.pieces(docs, 300))


def test_packing_equals_plain_tokenizer(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    for df in (docs, odd.union(odd.limit(1).withColumn("text", F.lit("<|endoftext|> foo's ΣΑΣ É́ a!b İ 3.14 x\u00a0y")))):
        rows = packing.pack(stored(packing.pieces(df, 300), "t"), 300).collect()
        want = Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
            for k, a in enumerate(range(0, len(ids), 300)):
                x = ids[a : a + 300]
                want[r.doc_id, k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        assert check_pack(rows, 300) <= 1.02 * -(-sum(r.length for r in rows) // 300) + 1


def test_packing_keeps_every_capacity(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 60, 800).tolist()
    for by in ("norm", "dot"):
        plan = packing.best_fit_plan(Counter(n), 100, most_docs=5, most_attention=5000, by=by)
        bins = defaultdict(list)
        for size, rank, each, first, at in plan.rows:
            nxt = min((r for s, r, *_ in plan.rows if s == size and r > rank), default=Counter(n)[size])
            for i in range(nxt - rank):
                bins[first + i // each].append((at + i % each * size, size))
        assert sorted(s for b in bins.values() for _, s in b) == sorted(n) and len(bins) == plan.bins
        for b in bins.values():
            assert len(b) <= 5 and sum(s for _, s in b) <= 100 and sum(s * s for _, s in b) <= 5000
            at = 0
            for o, s in sorted(b):
                assert o == at
                at += s
    assert packing.best_fit_plan({}, 100).bins == 0


@pytest.mark.parametrize("limits", [{}, {"most_docs": 100, "most_attention": 10000}])
def test_packing_selects_by_all_residuals(limits):
    """18 tokens fill the bin of 41 + 41 exactly, but that of 80 has less attention left: the norm of all three takes it."""
    plan = packing.best_fit_plan({80: 1, 41: 2, 18: 1}, 100, **limits)
    assert {r[0]: r[3] for r in plan.rows} == {80: 0, 41: 1, 18: 0}
    assert packing.best_fit_plan({1: 1000}, 100, **limits).bins == 10  # what cannot bind keeps nothing out


def test_packing_empty(empty):
    assert packing.pack(stored(packing.pieces(empty), "t")).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------
def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        rows = mixing.mix_rates(df).collect()
        assert len(rows) == df.count()
        by = defaultdict(list)
        for r in rows:
            assert r.mix_size == len(WORD.findall(r.text or "")) and 0 <= r.mix_copies <= 3
            by[r.source].append(r)
        for v in by.values():
            assert {r.mix_source_size for r in v} == {sum(r.mix_size for r in v)}
            rate = v[0].mix_target / v[0].mix_source_size if v[0].mix_source_size else 0
            assert all(math.floor(rate - 1e-9) <= r.mix_copies <= math.ceil(rate) for r in v)
        assert math.isclose(sum(v[0].mix_target for v in by.values()), min(sum(r.mix_size for r in rows), 3 * sum(v[0].mix_source_size for v in by.values())), rel_tol=1e-9)
        assert Counter((r.doc_id, r.text) for r in mixing.mix(df).collect()) == Counter({k: n for k, n in sum((Counter({(r.doc_id, r.text): r.mix_copies}) for r in rows), Counter()).items() if n})
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty).columns == empty.columns


def brute_targets(sizes):
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight, out, left = {x: mixing.WEIGHTS[i % 3] for i, x in enumerate(names)}, {}, sum(sizes.values())
    while rest := [x for x in names if x not in out]:
        unit = left / sum(weight[x] for x in rest)
        over = [x for x in rest if unit * weight[x] > 3 * sizes[x]]
        out |= {x: 3.0 * sizes[x] for x in over} if over else {x: unit * weight[x] for x in rest}
        left -= sum(3 * sizes[x] for x in over)
    return out


@pytest.mark.parametrize("broadcast", [100_000, 3])
def test_targets_and_draws_equal_brute_force(spark, docs, odd, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    few = [("a", 10), ("b", 1000), ("c", 1000), (None, 10), ("é", 500), ("Z", 1), ("\U0001f600", 7), ("\uffff", 3)]
    made = spark.createDataFrame([(i, "w " * n, x) for i, (x, n) in enumerate(few)], "doc_id long, text string, source string")
    chain = lambda values: functools.reduce(lambda h, v: h if v is None else xxhash.xxh64(v, h).intdigest(), values, 42)
    for df in (made, docs, odd):
        rows = mixing.mix_rates(df).collect()
        sizes = {x: sum(r.mix_size for r in rows if r.source == x) for x in {r.source for r in rows}}
        goal = brute_targets(sizes)
        for r in rows:
            assert math.isclose(r.mix_target, goal[r.source], rel_tol=1e-9) and r.mix_source_size == sizes[r.source]
            rate = min(3.0, r.mix_target / sizes[r.source]) if sizes[r.source] else 0.0
            h = chain([(20260812).to_bytes(4, "little"), None if r.doc_id is None else r.doc_id.to_bytes(8, "little"), None if r.text is None else r.text.encode(), None if r.source is None else r.source.encode()])
            assert r.mix_copies == math.floor(rate) + (h % 2**40 / 2**40 < rate - math.floor(rate))


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, "a b c", "s", "1", "2", "3", "4", "5") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _source string, mix_copies string, row string, n string, copy string")
    got = mixing.mix(df)
    assert got.columns == df.columns and {tuple(r)[1:] for r in got.collect()} == {r[1:] for r in rows}


# 8 ------------------------------------------------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end()))
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(out))


def brute_redacted(text):
    """Spans that overlap count as one, of the first's kind."""
    out, at, end = [], 0, -1
    for kind, a, b in (x.split(":") for x in brute_spans(text).split(",") if x):
        a, b = int(a), int(b)
        if a < end:
            end = max(end, b)
            continue
        out += [text[max(at, end) : a], f"<{kind.upper()}>"]
        at, end = b, b
    return "".join([*out, text[max(at, end) :]])


TRICKY = ["a@b.com_x@y.org z", "1.2.3.4.5.6.7.8 999.1.1.1 00000255.1.1.1", "+1 (555) 123-4567 +12 5", "4111 1111 1111 1111 2", "4111-1111-1111-1111 x 4111  1111", "é😀 a@b.c.d..e f@g..h", "1" * 5000 + " 4111111111111111", "@@a@b@c.d", "a@b.c.d.", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+1+2+33344455566 7", "a" * 3000 + "@b.c", "1." * 4000, "x@" * 2000]


def test_base_spans_equal_plain_patterns(spark, docs, odd):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), docs, odd):
        got = df.select("text", pii.listed(pii.base_spans(F.col("text"))).alias("s")).collect()
        for r in got:
            assert r.s == brute_spans(r.text), r.text[:100]


CARDS = ["4111111111111111", "5500000000000004", "4012888888881881", "378282246310005", "6011111111111117", "30569309025904", "3530111333300000"]


def test_contexts_are_bootstrapped(spark):
    """By the word before; by shape where words say nothing; not without either."""
    rows = [(i, f"call card: {c} now") for i, c in enumerate(CARDS)]
    rows += [(100, "my card: 123456789 lost"), (101, "order no 123456789"), (102, None), (102, None), (103, "order no 1234567890123456")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.l for r in pii.find_pii(df).withColumn("l", pii.listed(F.col("spans"))).collect()}
    assert out == {i: f"card:11:{11 + len(c)}" for i, c in enumerate(CARDS)} | {100: "context:9:18", 101: "", 102: "", 103: "context:9:25"}
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[100] == "my card: <CONTEXT> lost" and red[0] == "call card: <CARD> now" and red[101] == rows[8][1] and red[102] is None


def context_spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.doc_id]: [texts[r.doc_id][s.start : s.end] for s in r.spans if s["rank"] == pii.KINDS.index("context")] for r in pii.find_pii(rows).collect()}


def test_contexts_of_runs_starts_and_neighbours(spark):
    """Identifiers of several words, of letters and digits, at a text's start and right after another one; punctuation around stays outside."""
    phones = [f"+1 555-123-4{i:03d}" for i in range(20)]
    seeds = [f"reach me at {x} today" for x in phones] + [f"{x} rings twice" for x in phones] + [f"mail b{'c' * i}@d.org {x} please" for i, x in enumerate(phones)]
    new = {
        "reach me at 555 987 6543 tonight": "555 987 6543", "reach me at AB12 CD34 EF56 now": "AB12 CD34 EF56", "reach me at (9x8Y7z654)!! soon": "9x8Y7z654",
        "1234 5678 9012 3456 beeps": "1234 5678 9012 3456", "mail x@y.org 777888999 thanks": "777888999", "thing 998 877-66 please": "998 877-66",
    }
    plain = [f"part {700000 + i} of stock" for i in range(40)]
    got = context_spans(spark, seeds + list(new) + plain)
    assert {t: got[t] for t in new} == {t: [w] for t, w in new.items()}
    assert not any(got[t] for t in seeds + plain)


def test_assigned_credentials_are_seeds(spark):
    """Values of credential names are found, and from them others of their shape; versions and years in between are known to be none."""
    value = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    seeds = [f'word {i} token = "{value(i)}" more' for i in range(8)]
    got = context_spans(spark, [*seeds, f"| {value(99)} |", "version 3.0 of 1998", "note = plainwords"])
    assert all(got[t] == [value(i)] for i, t in enumerate(seeds)) and got[f"| {value(99)} |"] == [value(99)]
    assert not got["version 3.0 of 1998"] and not got["note = plainwords"]


def test_context_rounds_go_on_while_words_become_known(spark):
    """Each label is trusted only once the one before it has made half of its unknown numbers known; every label's numbers have a shape of their own."""
    seeds = [f"+1555000{i:04d}" for i in range(50)]
    numbers = [["/".join(f"{i:02d}{k}" for _ in range(k + 2)) for i in range(10)] for k in range(6)]
    labels = ["alpha:", "bravo:", "coyote:", "delta:", "echo:"]
    texts = [f"{x} {n}" for k, x in enumerate(labels) for n in seeds + (numbers[k - 1] if k else []) + numbers[k]]
    got = context_spans(spark, texts + [f"order {x}x99999" for x in range(100, 300)])
    assert all(got[f"{x} {n}"] for k, x in enumerate(labels) for n in numbers[k])
    assert not any(found for t, found in got.items() if t.startswith("order"))


def brute_trusted(found, support, share):
    words, edges, shapes = {}, defaultdict(set), set()
    for _, _, contexts in found:
        for c in contexts:
            for p in c["patterns"]:
                edges[p].add(c["node"])
            shapes.add(c["patterns"][-1])
            old = words.get(c["node"])
            words[c["node"]] = c["known"] if old is None else old if c["known"] is None else max(old, c["known"])
    conf = {w: None if k is None else float(min(k, 1)) for w, k in words.items()}
    while True:
        score = {}
        for p, own in edges.items():
            of = [conf[w] or 0.0 for w in own if conf[w] is not None or p not in shapes]
            if of and sum(of) / len(of) >= share and sum(c >= share for c in of) >= support:
                score[p] = sum(of) / len(of)
        best = defaultdict(float)
        for p, x in score.items():
            for w in edges[p]:
                best[w] = max(best[w], x)
        new = {w: best[w] for w, c in conf.items() if c is None and w in best}
        if not new:
            return {p: round(x, 9) for p, x in score.items()}
        conf |= new


@pytest.mark.parametrize("seed", range(3))
def test_pattern_scoring_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    known = {int(w): [None, None, None, 0, 1, 2, 2, 2, 2][rng.integers(9)] for w in range(120)}
    rows = [(i, i, [{"patterns": [int(x) for x in (w // 6 + rng.integers(0, 2, 4))] + [int(1000 + w % 7)], "node": int(w), "start": 0, "end": 1, "known": known[int(w)]} for w in rng.integers(0, 120, 6)]) for i in range(60)]
    df = stored(spark.createDataFrame(rows, f"doc_id long, th long, found {pii._CONTEXT}"), "t")
    got = {r.pattern: round(r.score, 9) for r in pii.trusted_patterns(df, 3, 0.75).collect()}
    assert got == brute_trusted(rows, 3, 0.75) and got


def test_pii_of_long_texts(spark):
    """Many matches, and overlapping ones of several kinds, in one text."""
    text = " ".join(f"item {1000000 + i} a{i}@b.org +1 555 {1000000 + i} 10.0.{i % 256}.1@c.de" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find_pii(df).select(pii.listed(F.col("base")).alias("b")).first().b
    assert got == brute_spans(text)
    assert pii.redact(df).first().text == brute_redacted(text)


def test_redact_keeps_clashing_columns(spark):
    rows = [(1, "write x@y.org", "th", "base", "spans", "extra", "row", "hidden", "c")] * 2 + [(2, None, *"abcdefg"), (None, "", *"abcdefg")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string, base string, spans string, extra string, row string, hidden string, found string")
    got = Counter(map(tuple, pii.redact(df).collect()))
    assert got == Counter([(r[0], "write <EMAIL>" if r[1] else r[1], *r[2:]) for r in rows])
    assert pii.redact(df).columns == df.columns and pii.redact(df.limit(0)).count() == 0


def test_pii_query_digest(spark, docs):
    for r in registry.queries()["op8_pii"](spark, SF).join(docs, "doc_id").limit(50).collect():
        want = brute_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("context")] == [x for x in want.split(",") if x]


def test_pii_empty(empty, odd):
    assert pii.find_pii(empty).count() == 0 and pii.redact(odd).count() == odd.count()


# 9 ------------------------------------------------------------------------------------------------------------
def test_url_rules_and_vocabulary(spark):
    want = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"),
        "http://www.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"), "http://xexample.com/en/": ("xexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"), "https://a.net/es/#t": ("a.net", "/es/", "net/es/", "block"), "https://a.net/de/": ("a.net", "/de/", None, "allow"),
        "http://a.org/free-hot-stuff": ("a.org", "/free-hot-stuff", None, "block"), "http://a.org/free/free": ("a.org", "/free/free", None, "allow"),
        "http://CASINO.org/x": ("casino.org", "/x", None, "block"), "http://casinos.org/x": ("casinos.org", "/x", None, "allow"), "http://a.org/p?q=xxx": ("a.org", "/p", None, "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(want)], "page_id long, url string, host int")
    got = {r.url: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == want


# 10 -----------------------------------------------------------------------------------------------------------
def test_url_clashing_columns_long_and_empty(spark):
    long = "http://a.org/" + "ü/" * 300_000 + "casino/x"
    rows = [(1, long, "h", "r", "row", "old"), (2, None, "h", "r", "row", "old")]
    df = spark.createDataFrame(rows, "page_id long, link string, _hits string, ruled string, row string, url_host string")
    out = url_filter.judge_urls(df, "link")
    got = {r.page_id: r for r in out.collect()}
    assert (got[1].url_verdict, got[2].url_verdict) == ("block", "allow") and {(r._hits, r.ruled, r.row) for r in got.values()} == {("h", "r", "row")}
    assert got[1].url_host == "a.org" and url_filter.judge_urls(df.limit(0), "link").count() == 0


def brute_top(rows, k, queries):
    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for i, a in {q[0]: q for q in v if queries(q[0])}.values():
        s = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in v if j != i and len(a) == len(b)))[:k]
        out |= {(i, r, j, -t) for r, (t, j) in enumerate(s, 1)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    few = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0, None, 2.0]), (1002, [float("nan"), 0.0, 0.0]), (1003, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (1050, [1.0, 2.0]), (1100, [0.5, 1.0]), (1150, [1e6, -1e6, 3e5])]
    rows = few + odd
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {tuple(r) for r in topk_search.top_k(v, v.filter("id % 50 = 0"), 5).collect()}
    assert got == brute_top(rows, 5, lambda i: i % 50 == 0)


def test_top_k_few_rows(spark):
    v = topk_search.quantised(spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert {tuple(r) for r in topk_search.top_k(v, v, 5).collect()} == {(0, 1, 50, 131072), (50, 1, 0, 131072)}
    assert topk_search.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_top_k_in_tiles_of_queries(spark, monkeypatch):
    """Several tiles and vector lengths, repeated rows, extra columns; of one query id with two vectors the least counts."""
    monkeypatch.setattr(topk_search, "TILE_SIZE", 64)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=[4, 6][i % 2])]) for i in rng.integers(0, 400, 500)]
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), "vec_id", "embedding").withColumn("score", F.lit("clash"))
    quantised = [(i, [math.floor(256 * x) for x in e]) for i, e in rows]
    queries = {i: min(e for j, e in quantised if j == i) for i, _ in rows if i % 3 == 0}
    want = set()
    for i, a in queries.items():
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in quantised if j != i and len(a) == len(b))[:5]
        want |= {(i, r, j, -t) for r, (t, j) in enumerate(best, 1)}
    got = [tuple(r) for r in topk_search.top_k(v, v.filter("id % 3 = 0"), 5).collect()]
    assert set(got) == want and len(got) == len(want)


def test_top_k_refuses_sums_beyond_62_bits(spark):
    v = spark.createDataFrame([(0, [1 << 40, 1]), (1, [1 << 40, 2])], "id long, v array<bigint>")
    with pytest.raises(ValueError, match="62 bits"):
        topk_search.top_k(v, v, 1)
