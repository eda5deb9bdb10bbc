"""Host-level quality rules with Spark expressions only.

Words are runs of anything but ASCII white space. A document's own statistics
decide first (`base_failed`: fewer than 50 words, or over half of its words lie
in three-word windows that occur twice or more). The method then works on
hosts: of the documents that are left, the failures of each soft rule are summed
by host, and rates are shrunk by a beta prior fitted to all hosts by moments. A
host whose shrunk rate for a rule is over HOST_LIMIT has a verdict for it, and the
documents of the host that break the rule go; over HOST_CLOSED nothing of the
host is trusted, and all of its documents go, clean ones too. Verdicts are joined
back to the documents. Where the rule is rarely broken, a host's few documents
that break it stay.

Null text has no words and fails. A null host is a host of its own. Equal lines,
windows and whole rows count each. Texts of any length take the same way. An empty
table gives an empty result; columns of any names stay. Statistics are taken from
whole texts once and written; hosts are summed on the map side, and the table of
verdicts is only broadcast where Spark finds its written size below its own limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.llm.common import let, staged

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Shrunk rates of failures above which a host's documents that break the rule go, and all of them.
HOST_LIMIT, HOST_CLOSED = 0.02, 0.75


def _no(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in three-word windows found twice or more.

    Windows are hashed; hash and position are packed into one number (as many
    low bits for positions as the text needs) and sorted, so windows of equal
    hashes stand together. Those that share theirs are sorted by their words,
    which makes the count exact whatever hashes collide."""

    def alone(order: Column, same) -> Column:
        """The elements of a sorted array that are the same as a neighbour."""
        last = F.size(order) - 1
        return F.filter(order, lambda x, k: ((k > 0) & same(x, order[F.greatest(k - 1, F.lit(0))])) | ((k < last) & same(x, order[F.least(k + 1, last)])))

    def packed(bits: Column) -> Column:
        hashed = lambda x: F.call_function("shiftrightunsigned", x, bits)
        key = lambda i: F.call_function("shiftleft", hashed(F.xxhash64(words[i], words[i + 1], words[i + 2])), bits).bitwiseOR(i.cast("bigint"))
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        order = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))
        found = let(order, lambda o: alone(o, lambda x, y: hashed(x) == hashed(y)))
        return F.transform(found, lambda x: x.bitwiseAND(low).cast("int"))

    def exact(places: Column) -> Column:
        spelt = F.sort_array(F.transform(places, lambda i: F.struct(words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i"))))
        equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.sort_array(let(spelt, lambda o: alone(o, equal)["i"]))

    def covered(p: Column) -> Column:
        step = lambda x, k: F.when(k == F.size(p) - 1, 3).otherwise(F.least(F.lit(3), p[F.least(k + 1, F.size(p) - 1)] - x))
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

    found = let(let(let(F.ceil(F.log2(n + F.lit(1))).cast("int"), packed), exact), covered)
    return F.when(n < 4, 0).otherwise(found).cast("bigint")


def statistics(df: DataFrame, text: str = "text", **names: Column) -> DataFrame:
    """df's columns in names, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))

    def all_of(words):
        n = F.size(words)
        return let(n, lambda n: F.struct(n.cast("bigint").alias("n_words"), repeat_words(words, n).alias("n_repeat_words")))

    def lines_of(lines):
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")

    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: _no(x, SPACES) > 0)
    found = df.select(
        *[c.alias(n) for n, c in names.items()],
        let(words, all_of).alias("s"),
        _no(body, SPACES).cast("bigint").alias("word_chars"),
        (F.length(body) - _no(body, SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lines_of).alias("n_dup_lines"),
    )
    return found.select(*names, F.col("s.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("s.n_repeat_words").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def soft_rules() -> dict[str, Column]:
    """Whether a document fails each rule that only counts on a bad host."""
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 20 * F.col("n_dup_lines") > F.col("n_words"),
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "lengths": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    }


def host_verdicts(stats: DataFrame, host: str = "host", limit: float = HOST_LIMIT, closed: float = HOST_CLOSED) -> DataFrame:
    """host, docs (those that pass the base rules), closed, and for each soft rule
    its shrunk rate and whether the host is bad.

    The beta prior of a rule has the mean m and variance v of the hosts' rates
    (v less what sampling alone would give): strength m (1 - m) / v - 1, between
    1 and 1e6; alpha = m * strength. Sums of whole numbers and one division make
    the rates the same however rows are dealt."""
    rules = soft_rules()
    hosts = stats.where(~base_failed()).groupBy(host).agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(c).alias(f"f_{n}") for n, c in rules.items()])
    hosts = staged(hosts, "hosts")
    parts = []
    for n in rules:
        rate = F.col(f"f_{n}") / F.col("docs")
        parts += [F.sum(f"f_{n}").alias(f"s_{n}"), F.round(F.avg(rate), 9).alias(f"m_{n}"), F.round(F.var_pop(rate), 9).alias(f"v_{n}")]
    prior = hosts.agg(F.sum("docs").alias("all_docs"), F.round(F.avg(1 / F.col("docs")), 9).alias("inv"), *parts).first()
    out, shut = [F.col(host), F.col("docs")], F.lit(False)
    for n in rules:
        m, v = prior[f"m_{n}"] or 0.0, prior[f"v_{n}"] or 0.0
        v = max(v - m * (1 - m) * (prior["inv"] or 0.0), 0.0)
        strength = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
        rate = (F.col(f"f_{n}") + m * strength) / (F.col("docs") + strength)
        out += [rate.alias(f"rate_{n}"), (rate > limit).alias(f"bad_{n}")]
        shut = shut | (rate > closed)
    return staged(hosts.select(*out, shut.alias("closed")), "verdicts")


def judge(stats: DataFrame, host: str = "host") -> DataFrame:
    """Add base_failed and kept to rows of statistics."""
    rules = soft_rules()
    verdicts = host_verdicts(stats, host).select(F.col(host).alias("v_host"), "closed", *[f"bad_{n}" for n in rules])
    joined = stats.join(verdicts, F.col(host).eqNullSafe(F.col("v_host")), "left")
    bad = F.coalesce("closed", F.lit(False))
    for n, failed in rules.items():
        bad = bad | (F.coalesce(f"bad_{n}", F.lit(False)) & failed)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(base_failed() | bad)).drop("v_host", "closed", *[f"bad_{n}" for n in rules])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    stats = staged(statistics(docs, doc_id=F.col("doc_id"), host=F.col("source")), "quality")
    return judge(stats).drop("host")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns.

    Statistics are taken once and written with the documents, so nothing is
    scanned twice; the table of verdicts comes to the documents."""
    names = {f"k{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    stats = staged(statistics(docs, text, **names, host=F.col(f"`{host}`")), "quality")
    return judge(stats).where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT rid, doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), grams AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM cut)
), twice AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), s AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words FROM cut LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (10 * n_symbols > n_words)::INT AS r1, (20 * n_dup_lines > n_words)::INT AS r2,
    (100 * n_repeat_words > 30 * n_words)::INT AS r3, (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS r4 FROM s
), h AS (
  SELECT host, count(*) AS docs, [sum(r1), sum(r2), sum(r3), sum(r4)] AS fs FROM f WHERE NOT base_failed GROUP BY host
), u AS (
  SELECT host, docs, unnest([1, 2, 3, 4]) AS k, unnest(fs)::DOUBLE AS n FROM h
), p AS (
  SELECT k, round(avg(n / docs), 9) AS m, round(var_pop(n / docs), 9) AS v, round(avg(1 / docs), 9) AS inv FROM u GROUP BY k
), q AS (
  SELECT k, m, CASE WHEN v - m * (1 - m) * inv > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) ELSE 1e6 END AS strength FROM p
), bad AS (
  SELECT host, list(rate > 0.02 ORDER BY k) AS b, max(rate) > 0.75 AS closed FROM (SELECT host, k, (n + m * strength) / (docs + strength) AS rate FROM u JOIN q USING (k)) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(closed OR (b[1] AND r1 = 1) OR (b[2] AND r2 = 1) OR (b[3] AND r3 = 1) OR (b[4] AND r4 = 1), false)) AS kept
FROM f LEFT JOIN bad ON f.host IS NOT DISTINCT FROM bad.host
"""
