"""Text functions as Spark columns: normalising, keys, spans and searching.

Offsets are code points, ends exclusive. White space means that of all scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift import vocab

WHITE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(x: str) -> str:
    """A string as SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(key: Column, table: dict[str, str]) -> Column:
    # One expression from SQL, as a call for each entry takes long to build.
    return F.expr(f"map({', '.join(literal(x) for kv in table.items() for x in kv)})")[key]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Trimmed, runs of white space as one space; null gives an empty string."""
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), WHITE, " "))


def compact(x: Column) -> Column:
    return F.regexp_replace(squeeze(x), r"(?U)[\s-]", "")


def canonical_type(x: Column) -> Column:
    name = F.upper(strip(F.coalesce(x, F.lit(""))))
    return F.coalesce(lookup(name, vocab.TYPE_ALIASES), F.replace(name, F.lit(" "), F.lit("_")))


def normalize_phone(x: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\D", "")
    return F.regexp_replace(digits, r"^91(.{10})$", "$1")


def normalize_dob(x: Column) -> Column:
    """yyyy-MM-dd for day-month-year with one kind of /, - or .; others unchanged."""
    v = squeeze(x)
    day = F.to_date(F.try_to_timestamp(F.translate(v, "-.", "//"), F.lit("d/M/yyyy")))
    shaped = [F.when(v.rlike(rf"^\d{{1,2}}{s}\d{{1,2}}{s}\d{{4}}$"), F.date_format(day, "yyyy-MM-dd")) for s in ("/", "-", r"\.")]
    return F.coalesce(*shaped, v)


def entity_key(kind: Column, value: Column) -> Column:
    """What makes two entities of a type the same, after the type and a line feed."""
    k = canonical_type(kind)
    same = F.when(k == "PHONE", normalize_phone(value)).when(k == "DOB", normalize_dob(value)).when(k.isin("AADHAAR", "DRIVING_LICENCE", "VOTER_ID"), compact(value)).otherwise(F.lower(squeeze(value)))
    return F.concat(k, F.lit("\n"), same)


def regex_value(kind: str, value: Column) -> Column:
    """The value that a pattern of this kind reports for its match."""
    value = strip(value)
    if kind in ("Aadhaar", "Phone", "Driving Licence"):
        value = F.regexp_replace(value, r"(?U)[\s-]", "")
    return F.upper(value) if kind in ("PAN", "Voter ID", "Driving Licence") else value


def display_type(kind: Column) -> Column:
    """Another spelling of types: known ones canonical, others with underscores."""
    k = strip(F.coalesce(kind, F.lit("")))
    return F.coalesce(lookup(F.upper(k), vocab.TYPE_ALIASES), F.replace(F.upper(k), F.lit(" "), F.lit("_")))


def display_value(kind: Column, value: Column) -> Column:
    """Squeezed; no spaces in numbers, capitals in PAN and voter ids, addresses without edge marks."""
    k, v = display_type(kind), squeeze(value)
    tight = F.replace(v, F.lit(" "), F.lit(""))
    return F.when(k.isin("AADHAAR", "PHONE", "DRIVING_LICENCE"), tight).when(k.isin("PAN", "VOTER_ID"), F.upper(v)).when(k == "ADDRESS", F.btrim(v, F.lit(" \t\r\n,;:"))).otherwise(v)


def normalize_entities(entities: Column) -> Column:
    """Entities named by (type, value) or (entity, text) as (type, value,
    confidence, source) in display form; blank ones go, gaps become 0 and "unknown"."""

    def one(e):
        kind, value = F.coalesce(e["type"], e["entity"], F.lit("")), F.coalesce(e["value"], e["text"], F.lit(""))
        return F.struct(display_type(kind).alias("type"), display_value(kind, value).alias("value"), F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(e["source"], F.lit("unknown")).alias("source"))

    return F.filter(F.transform(entities, one), lambda e: (e["type"] != "") & (e["value"] != ""))


#: Elements that running() adds up one by one; more go by sums of so many.
BLOCK = 128


def running(values: Column, zero: Column, merge) -> Column:
    """For each element, merge() of zero and all elements before it. Sums of blocks
    are made first, so an array of n elements takes n * BLOCK steps, not n * n."""

    def of_blocks(blocks):
        firsts = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, 1, b), zero, merge))
        return let(firsts, lambda f: F.transform(values, lambda _, i: F.aggregate(F.slice(values, i - i % BLOCK + 1, i % BLOCK), f[F.floor(i / BLOCK).cast("int")], merge)))

    count = F.ceil(F.size(values) / BLOCK).cast("int")
    numbers = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    return let(F.transform(numbers, lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), zero, merge)), of_blocks)


def runs(values: Column, begins) -> Column:
    """The array cut into arrays: begins(i) tells whether a run begins at place i > 0."""

    def cut(starts):
        stop = lambda k: F.coalesce(F.try_element_at(starts, k + 2), F.size(values))
        return F.transform(starts, lambda s, k: F.slice(values, s + 1, stop(k) - s))

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0))), lambda i: (F.size(values) > 0) & ((i == 0) | begins(i)))
    return let(places, cut)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (value, start, end) of a pattern's matches, left to right.

    Positions come from the lengths of matches and of what lies between them. A
    group must be the end of its match."""

    def place(parts):
        sizes = F.transform(parts["all"], lambda m, i: F.length(m) + F.length(parts["gaps"][i]))

        def one(before):
            def at(found, i):
                end = before[i] + F.length(parts["gaps"][i]) + F.length(parts["all"][i])
                return F.struct(found.alias("value"), (end - F.length(found)).alias("start"), end.alias("end"))

            return F.transform(parts["found"], at)

        return let(let(sizes, lambda x: running(x, F.lit(0), lambda a, b: a + b)), one)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if group else found
    parts = F.struct(whole.alias("all"), found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(parts, place)


def rfind(text: Column, word: Column) -> Column:
    """Last position of word in text from 0, or -1."""
    at = F.call_function("instr", F.reverse(text), F.reverse(word))
    return F.when(at == 0, -1).otherwise(F.length(text) - at - F.length(word) + 1)


def quoted(x: Column) -> Column:
    """A pattern that matches x itself."""
    return F.regexp_replace(x, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def locate_span(text: Column, value: Column) -> Column:
    """(start, end) of the first place of value in text, whatever case; if there
    is none, with any white space between its words; else null."""
    words = F.regexp_replace(quoted(squeeze(value)), " ", r"\\s+")
    tries = [F.concat(F.lit("(?iu)"), quoted(value)), F.concat(F.lit("(?iuU)"), words)]

    def place(pattern):
        hit = F.call_function("regexp_substr", text, pattern)
        start = F.call_function("regexp_instr", text, pattern) - 1
        return F.when(hit.isNotNull() & (hit != ""), F.struct(start.cast("int").alias("start"), (start + F.length(hit)).cast("int").alias("end")))

    return F.when(squeeze(value) != "", F.coalesce(*[let(t, place) for t in tries]))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def human_size(n: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    one = lambda x: F.format_string("%.1f", x.cast("double"))
    return F.when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < mb, F.concat(one(n / kb), F.lit(" KB"))).otherwise(F.concat(one(n / mb), F.lit(" MB")))


def ocr_normalize(x: Column) -> Column:
    return strip(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\f"), F.lit(" ")), r"[ \t]+", " "))


def ocr_score(text: Column) -> Column:
    """Points for what a scanned identity document should show, never below 0."""

    def points(t):
        hit = lambda p, n: F.when(t.rlike(p), n).otherwise(0)
        digits = F.length(F.regexp_replace(t, r"(?U)\D", ""))
        dates = r"(?U)\b\d{1,2}(/\d{1,2}/\d{4}|-\d{1,2}-\d{4}|\.\d{1,2}\.\d{4}|/\d{1,2}/\d{2})\b"
        names = F.regexp_count(t, F.lit(r"(?U)\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,3}\b"))
        lines = F.size(F.filter(F.split(t, "\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"), lambda x: strip(x) != ""))
        garbage = F.regexp_count(t, F.lit(r"(?U)[^A-Za-z0-9\s.,:/\-]"))
        parts = [
            hit(r"(?U)\b\d{4}\s?\d{4}\s?\d{4}\b", 50),
            F.when(digits >= 12, 35).otherwise(0),
            hit(dates, 30),
            hit(r"(?iuU)\bDOB\b", 15),
            hit(r"(?iuU)date\s+of\s+birth", 15),
            hit(r"(?iuU)\b(male|female)\b", 10),
            F.least(20 * names, F.lit(40)),
            *[F.when(F.contains(F.lower(t), F.lit(k)), 5).otherwise(0) for k in vocab.OCR_KEYWORDS],
            F.least(lines, F.lit(5)),
            F.when(F.regexp_count(t, F.lit("[A-Za-z0-9]")) >= 20, 5).otherwise(0),
            F.when(garbage > 20, -15).otherwise(0),
            F.when(garbage > 40, -20).otherwise(0),
            F.when(lines > 20, -10).otherwise(0),
        ]
        return F.greatest(reduce(lambda a, b: a + b, parts), F.lit(0)).cast("int")

    return let(ocr_normalize(text), points)
