"""Labelled synthetic forms with scanner noise.

Every pick is a hash of the row's number, a seed and a name, so a form is the
same however rows are dealt; distributions are those of random picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formsift import vocab
from formsift.functions.text import let

SEED = 42


def draw(name: str, n: int, seed: int = SEED, *more: Column) -> Column:
    """A whole number from 0 to n - 1, from the first 60 bits of an MD5 of seed, name and row."""
    said = F.md5(F.concat_ws("/", F.lit(f"{seed}/{name}"), F.col("id").cast("string"), *[m.cast("string") for m in more]).cast("binary"))
    return F.pmod(F.conv(F.substring(said, 1, 15), 16, 10).cast("bigint"), F.lit(n))


def chance(name: str, seed: int = SEED, *more: Column) -> Column:
    """A number from 0 to 1."""
    return draw(name, 1 << 30, seed, *more) / float(1 << 30)


def pick(name: str, values: list[str], seed: int = SEED) -> Column:
    return F.array(*map(F.lit, values))[draw(name, len(values), seed).cast("int")]


def _digits(name: str, n: int, seed: int) -> Column:
    return F.lpad(draw(name, 10**n, seed).cast("string"), n, "0")


def _letters(name: str, n: int, seed: int) -> Column:
    return F.concat(*[F.chr(F.lit(65) + draw(f"{name}{i}", 26, seed)) for i in range(n)])


def _date(name: str, mark: str, seed: int) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(mark, two(1 + draw(name + "d", 28, seed)), two(1 + draw(name + "m", 12, seed)), (1970 + draw(name + "y", 35, seed)).cast("string"))


def values(seed: int = SEED) -> dict[str, Column]:
    """One column a kind of value."""
    first, last = pick("first", vocab.FIRST_NAMES, seed), pick("last", vocab.LAST_NAMES, seed)
    return {
        "name": F.concat_ws(" ", first, last),
        "other": F.concat_ws(" ", pick("first2", vocab.FIRST_NAMES, seed), pick("last2", vocab.LAST_NAMES, seed)),
        "dob": _date("dob", "/", seed),
        "dob_dashed": _date("dob", "-", seed),
        "issued": _date("issued", "-", seed),
        "validity": _date("validity", "-", seed),
        "phone": F.concat((6 + draw("phone0", 4, seed)).cast("string"), _digits("phone", 9, seed)),
        "pan": F.concat(_letters("pan", 5, seed), _digits("pan", 4, seed), _letters("panz", 1, seed)),
        "aadhaar": F.concat((2 + draw("aadhaar0", 8, seed)).cast("string"), _digits("aadhaar", 11, seed)),
        "voter": F.concat(_letters("voter", 3, seed), _digits("voter", 7, seed)),
        "dl": F.concat(pick("state", vocab.STATE_CODES, seed), F.lpad((1 + draw("rto", 99, seed)).cast("string"), 2, "0"), (2014 + draw("year", 11, seed)).cast("string"), _digits("serial", 8, seed)),
        "address": F.concat((1 + draw("house", 9999, seed)).cast("string"), F.lit(" "), pick("street", vocab.STREETS, seed), F.lit(", "), pick("city", vocab.CITIES, seed)),
        "email": F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), pick("domain", vocab.EMAIL_DOMAINS, seed)),
        "org": pick("org", vocab.ORGANIZATIONS, seed),
    }


GOLD = {"NAME": "name", "DOB": "dob", "AADHAAR": "aadhaar", "ADDRESS": "address", "PAN": "pan", "DRIVING_LICENCE": "dl", "VOTER_ID": "voter", "PHONE": "phone", "EMAIL": "email"}


def locate(text: Column, kind: Column, value: Column) -> Column:
    start = F.call_function("instr", text, value) - 1
    return F.struct(kind.alias("type"), value.alias("value"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"))


def survivors(text: Column, entities: Column) -> Column:
    """Entities that are still in the text word for word, placed at their first occurrence."""
    return F.filter(F.transform(entities, lambda e: locate(text, e["type"], e["value"])), lambda e: e["start"] >= 0)


def character_noise(text: Column, seed: int = SEED, rate: float = 0.008) -> Column:
    """Look-alikes O0, I1, S5 swapped at a rate a character."""
    swapped = lambda c, i: F.when(chance("char", seed, i) < rate, F.translate(c, "O0I1S5", "0O1I5S")).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), swapped), "")


def spacing_noise(text: Column) -> Column:
    """No space between a digit and a capital, either way."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(\d)\s+([A-Z])", "$1$2"), r"(?U)([A-Z])\s+(\d)", "$1$2")


def punctuation_noise(text: Column, seed: int = SEED) -> Column:
    no_comma = F.when(chance("comma", seed) < 0.30, F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    return F.when(chance("colon", seed) < 0.20, F.replace(no_comma, F.lit(":"), F.lit(""))).otherwise(no_comma)


def line_noise(text: Column, seed: int = SEED) -> Column:
    """Of more than four lines, sometimes two neighbours swap."""

    def swap(lines):
        i = draw("line", 1 << 30, seed) % F.greatest(F.size(lines) - 1, F.lit(1))
        moved = F.transform(lines, lambda x, k: F.when(k == i, lines[F.least(k + 1, F.size(lines) - 1)]).when(k == i + 1, lines[F.greatest(k - 1, F.lit(0))]).otherwise(x))
        return F.array_join(F.when((F.size(lines) > 4) & (chance("lines", seed) < 0.20) & (chance("swap", seed) < 0.5), moved).otherwise(lines), "\n")

    return let(F.split(F.regexp_replace(text, r"\n$", ""), "\n"), swap)


def noisy(text: Column, seed: int = SEED) -> Column:
    """Nothing below 0.40; then characters, spacing from 0.55, marks from 0.65, lines from 0.75."""
    u = chance("level", seed)
    out = F.when(u >= 0.40, character_noise(text, seed)).otherwise(text)
    for least, step in ((0.55, spacing_noise), (0.65, lambda t: punctuation_noise(t, seed)), (0.75, lambda t: line_noise(t, seed))):
        out = F.when(u >= least, step(out)).otherwise(out)
    return out


def lines_of(layout: tuple) -> list[tuple[str, str | None]]:
    """(what is said, field or none) of a layout's lines."""
    _, heading, between, lines = layout
    out: list[tuple[str, str | None]] = [(heading + "\n", None)]
    for line in lines.split("|"):
        label, _, field = line.partition("=")
        out.append((label + between, field) if field else (label + "\n", None))
    return out


def gold_of(layout: tuple) -> list[tuple[str, str]]:
    """(type, field) of a layout's labelled values, in order."""
    types = {field: kind for kind, field in GOLD.items()}
    return [(types[field], field) for _, field in lines_of(layout) if field in types]


def generate(spark: SparkSession, n: int, seed: int = SEED, noise: bool = True) -> DataFrame:
    """document_id, document_type, text, entities of n forms; a narrow plan at any n."""
    made = values(seed)
    rows = spark.range(n).withColumns({f"v_{k}": c for k, c in made.items()}).withColumn("which", draw("type", len(vocab.LAYOUTS), seed).cast("int"))
    text, gold, kind = F.lit(None).cast("string"), F.lit(None), F.array(*[F.lit(x[0]) for x in vocab.LAYOUTS])[F.col("which")]
    for i, layout in enumerate(vocab.LAYOUTS):
        parts = [x for said, field in lines_of(layout) for x in ([F.lit(said)] if field is None else [F.lit(said), F.col(f"v_{field}"), F.lit("\n")])]
        text = F.when(F.col("which") == i, F.concat(*parts)).otherwise(text)
        listed = F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"v_{field}").alias("value")) for t, field in gold_of(layout)])
        gold = F.when(F.col("which") == i, listed) if i == 0 else gold.when(F.col("which") == i, listed)
    rows = rows.select("id", kind.alias("document_type"), text.alias("clean"), gold.alias("gold"))
    rows = rows.withColumn("text", noisy(F.col("clean"), seed) if noise else F.col("clean"))
    return rows.select(F.format_string("train_%06d", F.col("id") + 1).alias("document_id"), "document_type", "text", survivors(F.col("text"), F.col("gold")).alias("entities"))


def exact_split(df: DataFrame, key: str, shares: dict[str, int], seed: int = SEED) -> DataFrame:
    """Add `split`: by rank of a hash of the key, so many rows each, in the order of shares.

    Hashes are counted in 65,536 bins; of each bin that holds a cut the hash and key
    at the cut are found. Only keys are read for that, and no row moves. Rows beyond
    all shares get null; rows of one key stay together."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    b = F.shiftrightunsigned(h, 48).cast("int")
    keys = df.select(h.alias("h"), F.col(key).alias("k"), b.alias("b"))
    bins = sorted(tuple(r) for r in keys.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect())
    out, upto, cuts = F.lit(None).cast("string"), 0, []
    for name, n in shares.items():
        upto += n
        before = 0
        for number, count in bins:
            if before < upto <= before + count:
                last = keys.where(F.col("b") == number).orderBy("h", "k").limit(upto - before).agg(F.max(F.struct("h", "k")).alias("x")).first()["x"]
                same = F.struct(h.alias("h"), F.col(key).alias("k")) <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).cast(df.schema[key].dataType).alias("k"))
                cuts.append((name, (b < number) | ((b == number) & same)))
                break
            before += count
        else:
            cuts.append((name, F.lit(upto > 0)))
    for name, inside in reversed(cuts):
        out = F.when(inside, name).otherwise(out)
    return df.withColumn("split", out)


def replace_at(text: Column, start: Column, end: Column, value: Column) -> Column:
    return F.overlay(text, value, start + 1, end - start)
