"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts; built-in expressions only.

Arrays that a lambda function reads are bound first (`_bound`), running sums and maxima go by blocks (`_scan`), and stretches of a text are
cut from chunks of it (`_cut`), so work grows with the text's length, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import drop_stored, stored, table

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = r"A-Za-z0-9._%+-"
# Each finds the maximal, leftmost matches of the plain pattern in linear time: possessive parts, and starts only where a
# run of the first class starts or the last match ended (\G). Cards: digits singly joined by space or hyphen, 12 to 19.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPACE = r"\x20\x09-\x0D"
#: Known spans are overwritten by these (noncharacters, which no text interchange uses), an email's by the first, before words are looked at.
_AT, _ID = "\ufdd0", "\ufdd1"
#: Words that may be identifiers: those with a digit, an at sign, or a known span.
_TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@{_AT}{_ID}]*+[0-9@{_AT}{_ID}][^{_SPACE}]*+"
_CORE = rf"\p{{L}}\p{{N}}@{_AT}{_ID}"
_SPAN = "array<struct<start:int,rank:int,end:int>>"
_CONTEXT = "array<struct<patterns:array<bigint>,node:bigint,start:int,end:int,known:int>>"
_CHUNK = 1024

#: Values of at least SECRET letters and digits that are assigned to such a name are seeds, too.
CREDENTIALS = ("apikey", "api_key", "api-key", "auth", "authorization", "credential", "key", "passwd", "password", "pin", "pwd", "secret", "token")
SECRET = 16
#: A pattern is trusted from so many distinct known identifiers and such a share of them among its words; words of fewer digits are known to be none.
SUPPORT, SHARE, DIGITS = 5, 0.8, 6
#: Place of a candidate's shape among its patterns; those before it are lexical.
SHAPE = 4


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: inside a lambda function an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(values: Column, zero: int, join) -> Column:
    """Running join (a sum, a maximum) of an array<int>, itself included, in blocks of the root of its length: no step copies all that came before."""
    none = F.array().cast("array<int>")

    def running(xs: Column, start: Column) -> Column:
        first = F.struct(none.alias("out"), start.alias("at"))
        step = lambda acc, x: _bound(join(acc["at"], x), lambda v: F.struct(F.array_append(acc["out"], v).alias("out"), v.alias("at")))
        return F.aggregate(xs, first, step)["out"]

    def blocked(s: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["d"]) - 1) / s["b"]).cast("int")), lambda k: running(F.slice(s["d"], k * s["b"] + 1, s["b"]), F.lit(zero)))
        return _bound(each, lambda own: F.flatten(F.zip_with(own, F.slice(F.concat(F.array(F.lit(zero)), running(F.transform(own, lambda b: F.element_at(b, -1)), F.lit(zero))), F.lit(1), F.size(own)), lambda b, at: F.transform(b, lambda x: join(at, x)))))

    size = lambda d: F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(d)))).cast("int")
    return _bound(values, lambda d: F.when(F.size(d) > 0, _bound(F.struct(d.alias("d"), size(d).alias("b")), blocked)).otherwise(none))


def _total(values: Column) -> Column:
    return _scan(values, 0, lambda a, x: a + x)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of the text that the bound chunks make up."""
    lo = F.floor(start / _CHUNK).cast("int")
    n = F.floor((end - 1) / _CHUNK).cast("int") - lo + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(chunks, lo + 1, n), ""), start % _CHUNK + 1, end - start)).otherwise("")


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, word, gap>> of the matches, with places in code points, and what lies before each: what lies between matches gives the places."""

    def placed(s: Column) -> Column:
        ends = _total(F.zip_with(s["w"], F.slice(s["g"], F.lit(1), F.size(s["w"])), lambda w, g: F.length(w) + F.length(g)))
        return F.zip_with(F.zip_with(s["w"], ends, lambda w, e: F.struct((e - F.length(w)).alias("start"), e.alias("end"), w.alias("word"))), F.slice(s["g"], F.lit(1), F.size(s["w"])), lambda x, g: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"), g.alias("gap")))

    return _bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"), F.split(text, pattern, -1).alias("g")), placed)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, by start, then kind; null text: none."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(_SPAN)
    digits = lambda s: F.regexp_replace(s["word"], "[^0-9]", "")
    ok = {
        "email": lambda _: F.lit(True),
        "ip": lambda s: s["word"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda s: _luhn(digits(s)),
        "phone": lambda s: F.length(digits(s)).between(9, 15),
    }
    may = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": F.contains(t, F.lit("+"))}

    def each(i: int, k: str) -> Column:
        found = F.transform(F.filter(located(t, PATTERNS[k]), ok[k]), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end")))
        return F.when(may[k], found).otherwise(none)

    return F.array_sort(F.concat(*(each(i, k) for i, k in enumerate(PATTERNS))))


def regions(spans: Column) -> Column:
    """Sorted spans with overlapping ones made one, of the first's kind."""

    def firsts(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s["s"]) - 1), lambda i: (i == 0) | (F.get(s["s"], i)["start"] >= F.get(s["e"], i - 1)))
        return _bound(F.struct(s["s"].alias("s"), s["e"].alias("e"), starts.alias("f")), merged)

    def merged(s: Column) -> Column:
        last = lambda k: F.coalesce(F.get(s["f"], k + 1), F.size(s["s"])) - 1
        return F.transform(s["f"], lambda i, k: F.struct(F.get(s["s"], i)["start"].alias("start"), F.get(s["s"], i)["rank"].alias("rank"), F.get(s["e"], last(k)).alias("end")))

    ends = lambda b: _scan(F.transform(b, lambda x: x["end"]), 0, F.greatest)
    return _bound(spans, lambda b: F.when(F.size(b) > 0, _bound(F.struct(b.alias("s"), ends(b).alias("e")), firsts)).otherwise(F.array().cast(_SPAN)))


def replaced(text: Column, spans: Column, by) -> Column:
    """text with each region of spans, r, replaced by by(r)."""

    def put(s: Column) -> Column:
        before = lambda i: F.coalesce(F.get(s["r"], i - 1)["end"], F.lit(0))
        parts = F.transform(s["r"], lambda r, i: F.concat(_cut(s["c"], before(i), r["start"]), by(r)))
        return F.concat(F.array_join(parts, ""), _cut(s["c"], F.element_at(s["r"], -1)["end"], s["n"]))

    whole = F.struct(regions(spans).alias("r"), _chunks(text).alias("c"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, _bound(whole, put)).otherwise(text)


def contexts(text: Column, base: Column) -> Column:
    """Candidates, each with hashes of its patterns and of its text (node), its place and whether it is known: 2 a span of base, 1 another identifier, 0 none, null unknown.

    A candidate is a word with a digit or an at sign, without the punctuation around it. Spans of base are known identifiers; so are values assigned to
    one of CREDENTIALS. Adjacent words of digits are one candidate if only blanks are between and no comma or semicolon ends the first.
    Patterns: its class (with an at sign or not) with the word before, the two before, the word after, and both, lower-cased; and its shape
    (kind of characters, and how many digits or hexadecimal ones). Where no word is between, the neighbouring candidate's class stands
    for it, or the text's start or end.
    """
    raw = F.coalesce(text, F.lit(""))
    masks = rf"[{_AT}{_ID}]"
    kind = lambda w: F.when(w.rlike(f"[@{_AT}]"), "\t@").otherwise("\t9")
    word = lambda s, i: F.get(s["t"], i)["word"]
    gap = lambda s, i: F.get(s["t"], i)["gap"]

    def cut(s: Column) -> Column:
        alone = f"[@{_AT}{_ID}]"

        def joined(i: Column) -> Column:
            return gap(s, i).rlike(r"^[\x20\t]++$") & ~word(s, i - 1).rlike("[,;]$") & ~word(s, i - 1).rlike(alone) & ~word(s, i).rlike(alone)

        first = F.filter(F.sequence(F.lit(0), F.size(s["t"]) - 1), lambda i: (i == 0) | ~joined(i))
        return _bound(F.struct(s["t"].alias("t"), s["rest"].alias("rest"), s["c"].alias("c"), first.alias("f")), described)

    def described(s: Column) -> Column:
        def one(a: Column, j: Column) -> Column:
            b = F.coalesce(F.get(s["f"], j + 1), F.size(s["t"])) - 1
            own = F.slice(s["t"], a + 1, b - a + 1)
            whole = F.concat(F.element_at(own, 1)["word"], F.array_join(F.transform(F.slice(own, F.lit(2), F.size(own)), lambda x: F.concat(x["gap"], x["word"])), ""))
            left = F.lower(F.regexp_extract(gap(s, a), rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]++$", 1))
            two = F.lower(F.regexp_extract(gap(s, a), rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]++[^{_SPACE}]++[{_SPACE}]++$", 1))
            left = F.when(left != "", left).when(a == 0, "\t^").otherwise(kind(word(s, a - 1)))
            after = F.when(b + 1 < F.size(s["t"]), gap(s, b + 1)).otherwise(s["rest"])
            right = F.lower(F.regexp_extract(after, rf"^[{_SPACE}]*+([^{_SPACE}]++)", 1))
            right = F.when(right != "", right).when(b + 1 == F.size(s["t"]), "\t$").otherwise(kind(word(s, b + 1)))
            sides = F.struct(left.alias("l"), two.alias("l2"), right.alias("r"), F.get(s["t"], a)["start"].alias("start"), F.get(s["t"], b)["end"].alias("end"))
            return _bound(whole, lambda w: _bound(F.struct(w.alias("w"), edge(w, rf"^[^{_CORE}]*+").alias("head"), edge(w, rf"(?<=[{_CORE}])[^{_CORE}]*+$").alias("tail"), kind(w).alias("k"), sides.alias("s")), core_of))

        def edge(w: Column, pattern: str) -> Column:
            return F.length(F.regexp_extract(w, pattern, 0))

        def core_of(x: Column) -> Column:
            core = F.substring(x["w"], x["head"] + 1, F.length(x["w"]) - x["head"] - x["tail"])
            return F.struct(x["k"].alias("k"), *(x["s"][c].alias(c) for c in ("l", "l2", "r")), core.alias("w"), (x["s"]["start"] + x["head"]).alias("start"), (x["s"]["end"] - x["tail"]).alias("end"), core.rlike(masks).alias("base"))

        return F.transform(F.filter(F.transform(s["f"], one), lambda x: x["end"] > x["start"]), lambda x: finished(s, x))

    def finished(s: Column, x: Column) -> Column:
        core = F.when(x["base"], _cut(s["c"], x["start"], x["end"])).otherwise(x["w"])
        return _bound(F.struct(core.alias("w"), F.length(F.regexp_replace(core, "[^0-9]", "")).alias("d"), x.alias("x")), hashed)

    def hashed(y: Column) -> Column:
        core, x, any_word, size = y["w"], y["x"], F.lit("\t*"), F.length(y["w"])
        shape = F.when(y["d"] == size, F.concat(F.lit("d"), size)).when(core.rlike(f"^[0-9A-Fa-f]{{{SECRET},}}+$"), F.concat(F.lit("h"), size))
        shape = shape.otherwise(F.regexp_replace(F.regexp_replace(core, r"\p{L}++", "a"), r"[0-9]++", "9"))
        secret = x["l"].isin("=", ":") & F.regexp_replace(x["l2"], r"^[^a-z]++|[^a-z]++$", "").isin(*CREDENTIALS) & core.rlike(rf"^[A-Za-z0-9+/_=.-]{{{SECRET},}}+$")
        known = F.when(x["base"], 2).when(secret, 1).when(y["d"] < DIGITS, 0)
        patterns = F.array(F.xxhash64(x["k"], x["l"], any_word), F.xxhash64(x["k"], x["l2"], x["l"], any_word), F.xxhash64(x["k"], any_word, x["r"]), F.xxhash64(x["k"], x["l"], x["r"]), F.xxhash64(F.lit("\ts"), shape))
        return F.struct(patterns.alias("patterns"), F.xxhash64(core).alias("node"), x["start"].alias("start"), x["end"].alias("end"), known.alias("known"))

    def masked(t: Column) -> Column:
        hidden = replaced(t, base, lambda r: F.repeat(F.when(r["rank"] == 0, _AT).otherwise(_ID), r["end"] - r["start"]))
        of = lambda m: F.struct(located(m, _TOKEN).alias("t"), F.element_at(F.split(m, _TOKEN, -1), -1).alias("rest"), _chunks(t).alias("c"))
        return _bound(hidden, lambda m: _bound(of(m), lambda s: F.when(F.size(s["t"]) > 0, cut(s)).otherwise(F.array().cast(_CONTEXT))))

    clean = F.when(raw.rlike(masks), F.translate(raw, _AT + _ID, "\ufffd\ufffd")).otherwise(raw)
    return F.when(raw.rlike("[0-9@]"), _bound(clean, masked)).otherwise(F.array().cast(_CONTEXT))


def slim(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, found): a hash of the text, base spans and contexts of each row."""
    out = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", base_spans(F.col("text")).alias("base"))
    return out.select("doc_id", "th", "base", contexts(F.col("text"), F.col("base")).alias("found"))


def trusted_patterns(slim_docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(pattern, score), stored: hashes of patterns whose words are identifiers often enough.

    The graph joins patterns and words. Known identifiers seed it with confidence 1, words known to be none with 0. Each round scores a pattern by the
    mean confidence of its distinct words, and an unknown word by its best trusted pattern; from then on its nature counts as known,
    so patterns trusted in one round let words of others count in the next. Words of unknown nature count against a lexical pattern, since any
    word may stand in a context; a shape is judged by its words of known nature alone. A word's confidence never falls; rounds end when
    one makes no further word known. Edges are distinct before they are shuffled by pattern or by word, and counts are summed within tasks.
    """
    each = slim_docs.select(F.explode("found").alias("c")).select(F.posexplode("c.patterns").alias("place", "pattern"), F.col("c.node").alias("word"), "c.known")
    edges = stored(each.groupBy("pattern", "word").agg(F.max("known").alias("known"), F.max(F.col("place") == SHAPE).alias("shape")), "pii-edges")
    words = stored(edges.groupBy("word").agg(F.max(F.col("known") > 0).cast("double").alias("conf")), "pii-words")
    count = words.filter("conf IS NOT NULL").count()
    while True:
        # keys are wrapped, so that both sides of a join are dealt out for it alone and a hot key can be split
        known = edges.select("pattern", "word", "shape").join(words.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"))
        mean = F.avg(F.when(F.col("shape"), F.col("conf")).otherwise(F.coalesce("conf", F.lit(0.0))))
        score = known.groupBy("pattern").agg(mean.alias("score"), F.count_if(F.col("conf") >= share).alias("n")).filter((F.col("score") >= share) & (F.col("n") >= support))
        score = stored(score.select("pattern", "score"), "pii-patterns")
        best = edges.select("pattern", "word").join(score.withColumnRenamed("pattern", "_p"), F.col("pattern") == F.col("_p")).groupBy("word").agg(F.max("score").alias("best"))
        fresh = stored(words.join(best.select((F.col("word") + F.lit(0)).alias("_b"), "best"), F.col("word") == F.col("_b"), "left").select("word", F.coalesce("conf", "best").alias("conf")), "pii-words")
        drop_stored(words)
        words, before, count = fresh, count, fresh.filter("conf IS NOT NULL").count()
        if count == before:
            drop_stored(edges, words)
            return score
        drop_stored(score)


def discovered(slim_docs: DataFrame, **how) -> DataFrame:
    """(doc_id, th, extra): spans that the method adds, stored: seeds beyond base, and unknown candidates with a trusted pattern; one row for rows of equal id and text."""
    trusted = trusted_patterns(slim_docs, **how)
    each = slim_docs.select("doc_id", "th", F.explode("found").alias("c"))
    span = F.struct(F.col("c.start").alias("start"), F.lit(KINDS.index("context")).alias("rank"), F.col("c.end").alias("end")).alias("span")
    seeds = each.filter("c.known = 1").select("doc_id", "th", span)
    unknown = each.filter("c.known IS NULL").select("doc_id", "th", span, F.explode("c.patterns").alias("pattern"))
    hits = unknown.join(trusted.select(F.col("pattern").alias("_p")), F.col("pattern") == F.col("_p"), "left_semi").select("doc_id", "th", "span")
    out = stored(seeds.union(hits).groupBy("doc_id", "th").agg(F.collect_set("span").alias("extra")), "pii-extra")
    drop_stored(trusted)
    return out


def _with_extra(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """docs (with doc_id, th, base) and spans: base and discovered ones, by start, then kind."""
    more = extra.select(F.col("doc_id").alias("_i"), F.col("th").alias("_t"), "extra")
    out = docs.join(more, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPAN))))).drop("_i", "_t", "extra")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, base, spans) of each row: base spans, and those with what the method adds, as array<struct<start, rank, end>>.

    rank is the kind's place in KINDS; places are code points, end exclusive. Null and empty texts have no spans; rows of
    equal id and text get equal spans; other columns are ignored; an empty table gives no rows. Work and memory for a row are in proportion to its text.
    """
    rows = stored(slim(docs), "pii-slim")
    return _with_extra(rows, discovered(rows, **how)).select("doc_id", "base", "spans")


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; overlapping spans count as one, of the first's kind.

    Null and empty texts stay as they are, repeated rows stay repeated, all columns keep their names and values but for text; an empty table stays empty.
    """
    rows = stored(slim(docs), "pii-slim")
    extra = discovered(rows, **how)
    drop_stored(rows)
    # the row goes along as a struct, so that no name of its columns can clash
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("th"), base_spans(F.col("text")).alias("base"))
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    out = _with_extra(boxed, extra)
    hidden = replaced(F.col("text"), F.col("spans"), lambda r: F.get(kinds, r["rank"]))
    return out.withColumn("hidden", hidden).select(*(F.col("hidden").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(n, KINDS[:4]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
