"""Quality rules with cutoffs whose false rejections are bounded.

Fixed rules fail a document outright (too few words, too much repetition). Beyond them,
RULES measure shares in thousandths, and a document goes if one is over its cutoff. Cutoffs
come from labelled documents, stratum by stratum (a language). One half of them (by a hash)
proposes: for each level, each rule's lowest cutoff of GRID that rejects at most so many
thousandths of the good ones. The other half, the holdout, decides: a level's false
rejections by all its rules together are counted, and the level is certified if an exact
binomial test refutes a rate over LIMIT. Holm's step-down over all strata and levels keeps
the chance that any certified level exceeds the limit under RISK. Of a stratum's certified
levels the one that separates the proposing half best is used; with none, its documents
meet the fixed rules only.

Only DataFrame functions are used, and nothing but labelled rows' features is shuffled: words
repeated in a document are found inside its row, by sorting hashes of its three-word
windows, each packed with its place. Texts are read once. Cutoffs of at most some 200,000
strata are broadcast, more are joined by shuffle.

Defined results: a null or empty text has no words and fails; a null language is the stratum
`und`; a document without label, or with a null doc_id, is judged like any other; repeated
rows are judged each, and each counts in its half if labelled; a doc_id with
several labels is good if one says so; a null label is none; empty tables give no rows or no
cutoffs; other columns of documents and labels are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import once
from newsloom.llm.durable import cut, narrow

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS, CAPITALS = "[#*$%&|<>]", "[A-Z]"
WINDOW = 3
MIN_WORDS, MOST_REPEATED = 50, 50
#: Numerator and denominator of each rule's share.
RULES = {"symbols": ("n_symbols", "n_words"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines")}
#: Cutoffs and levels, both in thousandths.
GRID = (50, 100, 150, 200, 250, 300, 350, 400, 450, 600, 800, 1000, 1500, 2500)
LEVELS = (0, 1, 2, 5, 10)
LIMIT, RISK = 0.02, 0.05
#: A good document lost counts as so many bad ones caught when a certified level is chosen.
PRICE = 3
#: Terms of a binomial tail that are added one by one; what is beyond is bounded from above.
TERMS = 100_000


def _repeated(w: Column, bits: Column, seed: int) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more in w; null if two unlike windows share a packed hash.

    bits: how many hold any place in w.
    """
    last = F.size(w) - WINDOW
    high = lambda x: F.call_function("shiftright", x, bits)  # noqa: E731
    place = lambda x: x - F.call_function("shiftleft", high(x), bits)  # noqa: E731
    window = lambda i: [F.get(w, i + k) for k in range(WINDOW)]  # noqa: E731
    pack = lambda i: F.call_function("shiftleft", high(F.xxhash64(F.lit(seed), *window(i))), bits) + i  # noqa: E731
    like = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))  # noqa: E731

    def unlike(twice: Column) -> Column:
        """Whether neighbours of one hash are windows of different words."""
        differ = lambda x, y: ~F.array(*window(place(x).cast("int"))).eqNullSafe(F.array(*window(place(y).cast("int"))))  # noqa: E731
        return F.exists(F.transform(twice, lambda x, i: like(x, F.get(twice, i - 1)) & differ(x, F.get(twice, i - 1))), lambda found: found)

    def covered(places: Column) -> Column:
        new = F.transform(places, lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW).cast("long"))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeats(p: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: high(F.get(p, i)) == high(F.get(p, i + 1)))
        return F.sort_array(F.array_distinct(F.flatten(F.transform(firsts, lambda i: F.array(F.get(p, i), F.get(p, i + 1))))))

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), last), pack))
    twice = once(packed, repeats)
    count = once(twice, lambda t: F.when(~unlike(t), once(F.sort_array(F.transform(t, place)), covered)))
    return F.when(last < 1, F.lit(0).cast("long")).otherwise(count)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and each rule's value."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("stratum"), text.alias("text")).select(
        "doc_id", "stratum", F.filter(F.split("text", SPACE), lambda x: x != "").alias("w"), lines.alias("lines"),
        *[F.regexp_count("text", F.lit(chars)).cast("long").alias(name) for name, chars in (("n_symbols", SYMBOLS), ("n_capitals", CAPITALS))],
    )  # fmt: skip
    counted = read.withColumn("bits", F.length(F.bin(F.size("w").cast("long")))).select(
        "doc_id", "stratum", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", "n_capitals", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(*[_repeated(F.col("w"), F.col("bits"), seed) for seed in range(3)]).alias("n_repeat_words"),
    )  # fmt: skip
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    shares = [F.expr(f"1000 * {over} div greatest({under}, 1)").alias(rule) for rule, (over, under) in RULES.items()]
    return counted.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *shares)


def _log_factorial(n: Column) -> Column:
    """From a table up to 19, then by Stirling's series, which is good to 14 digits from there."""
    x = n + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(19)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """The chance of at most k of n at this rate: the sum from the term of k down, each from the one before.

    From the mean on it is given as 1, which refutes nothing. After TERMS terms the rest is bounded by its geometric series.
    """
    odds = (1 - rate) / rate
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    steps = F.least(k, F.lit(TERMS).cast("long"))
    down = lambda at: (k - at + 1) * odds / (n - k + at)  # noqa: E731
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, at: Column) -> Column:
        term = acc["term"] * down(at)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    beyond = lambda acc: F.when(k > steps, acc["term"] * down(steps + 1) / (1 - down(steps + 1))).otherwise(0.0)  # noqa: E731
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>")), begin, step, lambda acc: acc["sum"] + beyond(acc))
    return F.when(k >= n * rate, 1.0).otherwise(F.least(F.lit(1.0), F.exp(first) * total))


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of features() that the fixed rules pass and a label covers, with good and proposing."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    half = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"
    return found.filter(~F.col("base_failed")).select("doc_id", "stratum", *RULES).join(good, "doc_id").withColumn("proposing", half)


def proposals(rows: DataFrame) -> DataFrame:
    """stratum, level and a cutoff for each rule (null: none of GRID rejects so few), from the proposing half."""
    over = {(r, g): F.count_if(F.col("good") & (F.col(r) > g)).alias(f"{r}_{g}") for r in RULES for g in GRID}
    counted = rows.filter("proposing").groupBy("stratum").agg(F.count_if("good").alias("n"), *over.values()).filter("n > 0")
    within = lambda r, g: 1000 * F.col(f"{r}_{g}") <= F.col("level") * F.col("n")  # noqa: E731
    cutoffs = [F.coalesce(*[F.when(within(r, g), F.lit(g)) for g in GRID]).alias(r) for r in RULES]
    return counted.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).select("stratum", "level", *cutoffs)


def rejects(prefix: str = "") -> Column:
    """Whether any rule's value is over its cutoff, named like the rule after the prefix."""
    hits = [F.coalesce(F.col(r) > F.col(prefix + r), F.lit(False)) for r in RULES]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def certified(rows: DataFrame, proposed: DataFrame) -> DataFrame:
    """The cutoffs of each stratum that has a certified level: stratum, level and at_<rule>."""
    at = proposed.withColumnsRenamed({r: f"at_{r}" for r in RULES})
    n = lambda half, good: F.count_if(F.lit(True) & (F.col("proposing") if half else ~F.col("proposing")) & (F.col("good") if good else ~F.col("good")) & F.col("out"))  # noqa: E731
    held = F.count_if(~F.col("proposing") & F.col("good")).alias("n")
    tried = rows.join(narrow(at), "stratum").withColumn("out", rejects("at_"))
    counted = tried.groupBy("stratum", "level", *[f"at_{r}" for r in RULES]).agg(held, n(False, True).alias("k"), n(True, False).alias("caught"), n(True, True).alias("lost"))
    p = F.when(F.col("n") > 0, binomial_tail(F.col("k"), F.col("n"), LIMIT)).otherwise(1.0)
    # Holm: one row a stratum and level, so the window over all of them is small
    order = W.orderBy("p", "stratum", "level")
    ranked = counted.withColumn("p", p).withColumn("place", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(W.partitionBy()))
    passed = ranked.withColumn("ok", F.min(F.col("p") <= RISK / (F.col("m") - F.col("place") + 1)).over(order.rowsBetween(W.unboundedPreceding, 0))).filter("ok")
    best = F.max_by(F.struct("level", *[f"at_{r}" for r in RULES]), F.struct(F.col("caught") - PRICE * F.col("lost"), -F.col("level")))
    return passed.groupBy("stratum").agg(best.alias("b")).select("stratum", "b.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    found = cut(features(docs))
    rows = cut(labelled(found, labels))
    chosen = cut(certified(rows, cut(proposals(rows))))
    out = F.col("base_failed") | rejects("at_")
    return found.join(narrow(chosen), "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~out).alias("kept"))


_GRID = ", ".join(f"({g})" for g in GRID)
_LEVELS = ", ".join(f"({x})" for x in LEVELS)
_VALUES = ", ".join(f"1000 * {over} // greatest({under}, 1) AS {rule}" for rule, (over, under) in RULES.items())
_OVER = " OR ".join(f"coalesce(f.{r} > c.{r}, false)" for r in RULES)
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, regexp_extract_all(text, '[^ 	-]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ln, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, len(regexp_extract_all(text, '{CAPITALS}')) AS n_capitals FROM d),
p AS (SELECT id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
t AS (SELECT id, i FROM p QUALIFY count(*) OVER (PARTITION BY id, a, b, c) > 1), r AS (SELECT id, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) o(k) GROUP BY id),
n AS (SELECT d.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_capitals, len(ln) AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (id) LEFT JOIN r USING (id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_VALUES} FROM n),
g AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT f.*, good, substr(md5(doc_id::VARCHAR), 1, 1) < '8' AS proposing FROM f JOIN g USING (doc_id) WHERE NOT base_failed),
q AS (SELECT stratum, level.v AS level, {", ".join(f"(SELECT min(v) FROM (VALUES {_GRID}) z(v) WHERE 1000 * (SELECT count(*) FROM x y WHERE y.stratum = s.stratum AND proposing AND good AND y.{r} > z.v) <= level.v * s.n) AS {r}" for r in RULES)}
  FROM (SELECT stratum, count(*) AS n FROM x WHERE proposing AND good GROUP BY stratum) s, (VALUES {_LEVELS}) level(v)),
h AS (SELECT c.stratum, c.level, count(*) FILTER (NOT proposing AND good) AS n, count(*) FILTER (NOT proposing AND good AND out) AS k, count(*) FILTER (proposing AND NOT good AND out) - {PRICE} * count(*) FILTER (proposing AND good AND out) AS gain
  FROM (SELECT f.good, f.proposing, c.stratum, c.level, {_OVER} AS out FROM x f JOIN q c USING (stratum)) c GROUP BY ALL),
v AS (SELECT *, CASE WHEN n = 0 OR k >= n * {LIMIT}::DOUBLE THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({LIMIT}::DOUBLE) + (n - j) * ln(1 - {LIMIT}::DOUBLE))) FROM (SELECT unnest(range(k + 1)) AS j)) END AS p FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY p, stratum, level) AS place, count(*) OVER () AS m FROM v),
y AS (SELECT *, bool_and(p <= {RISK}::DOUBLE / (m - place + 1)) OVER (ORDER BY place) AS ok FROM o),
b AS (SELECT stratum, level FROM y WHERE ok QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, level) = 1),
c AS (SELECT q.* FROM q JOIN b USING (stratum, level))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {_OVER}) AS kept FROM f LEFT JOIN c USING (stratum)
"""
