"""Hand-derived vectors and plain-Python versions of the document rules."""

import io
import os
import random
import re
import time
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from formsift import vocab
from formsift.functions import scoring, text
from formsift.operators import analytics, context, evaluate, extract, prep, reconcile, route, synth
from formsift.plans import pipeline, queries
from formsift.sources import files
from formsift.streaming import stream

TEXTS = [
    ("mail rahul.sharma@gmail.com and 9876543210. PAN: ABCDE1234F.", [("Email", "rahul.sharma@gmail.com", 5, 27), ("Phone", "9876543210", 32, 42), ("PAN", "ABCDE1234F", 49, 59)]),
    ("Aadhaar Number: 2345 6789 0123. Name: Priya Das.", [("Aadhaar", "234567890123", 16, 30)]),
    ("919876543210", [("Aadhaar", "919876543210", 0, 12)]),
    ("+919876543210", [("Phone", "+919876543210", 0, 13), ("Aadhaar", "919876543210", 1, 13)]),
    ("+91 9876543210", [("Phone", "+919876543210", 0, 14)]),
    ("X9876543210", []),
    ("DL: OD-01-20230012345", [("Driving Licence", "OD0120230012345", 4, 21)]),
    ("dl XX0120230012345", []),
    ("voter abc1234567", [("Voter ID", "ABC1234567", 6, 16)]),
    ("DOB: 15/08/20041", [("DOB", "15/08/2004", 5, 15)]),
    ("date of birth is 1-2-1999", [("DOB", "1-2-1999", 17, 25)]),
    ("DOB\n05/06/2000", [("DOB", "05/06/2000", 4, 14)]),
    ("published on 12/03/2021", []),
    ("\U0001f600 a@b.co \U0001f600 c@d.org", [("Email", "a@b.co", 2, 8), ("Email", "c@d.org", 11, 18)]),
    ("   ", []),
]


def test_candidates_and_spans(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in TEXTS)), "i int, t string")
    got = {r["i"]: [(c["type"], c["value"], c["start"], c["end"]) for c in r["c"]] for r in df.select("i", extract.regex_candidates(F.col("t")).alias("c")).collect()}
    for i, (_, want) in enumerate(TEXTS):
        assert got[i] == want, TEXTS[i][0]


ROLES = [
    ("NAME", "Father's Name: Ravi Das", 15, "primary", "name"),
    ("NAME", "S/O Ravi Das", 4, "secondary_person", "s/o"),
    ("NAME", "Nominee: Ravi Das", 9, "secondary_person", "nominee"),
    ("NAME", "Nominee Name: Ravi Das", 14, "primary", "name"),
    ("DOB", "DOB\n05/06/2000", 4, "primary", "dob"),
    ("DOB", "Date of Issue: 01/01/2020", 15, "non_target", "date of issue"),
    ("PAN", "Company: ABCDE1234F", 9, "primary", "pan"),
    ("Driving Licence", "DL: OD0120230012345", 4, "unknown", ""),
    ("EMAIL", "Form\nHR Email:\nhr@example.test\nEmail: a@b.com", 15, "primary", "email"),
    ("EMAIL", "Form\nHR Email:\nhr@example.test\nEmail: a@b.com", 38, "non_target", "hr email"),
    ("NAME", "anything", None, "unknown", ""),
]


def test_roles(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROLES)], "i int, k string, t string, s int")
    got = {r["i"]: r["r"] for r in df.select("i", context.role(F.col("k"), F.col("t"), F.col("s")).alias("r")).collect()}
    for i, (*_, role, label) in enumerate(ROLES):
        assert (got[i]["context_role"], got[i]["context_label"]) == (role, label)
    assert got[10]["context_model"] == "none" and got[0]["context_model"] == "nearest_field"


ENTITY = "struct<type:string,value:string,confidence:double,source:string,start:int,end:int,validated:boolean,context_role:string,context_label:string,context_score:double,context_model:string,format_valid:boolean,methods_agree:boolean>"


def ent(kind, value, conf=0.9, source="deberta", start=None, end=None, score=0.0, role="unknown"):
    return (kind, value, conf, source, start, end, False, role, "", score, "none", None, None)


def settled(spark, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, e array<{ENTITY}>").repartition(3)
    return [r["x"] for r in df.select("i", reconcile.reconcile(F.col("e")).alias("x")).orderBy("i").collect()]


def test_reconcile_vectors(spark):
    cases = [
        [ent("PAN", "ABCDE1234F", 0.97, "regex"), ent("PAN", "ABCDE1234F", 0.82, "llm/context")],
        [ent("NAME", "A B", 0.90, start=0, end=3), ent("NAME", "A B", 0.95, start=0, end=3), ent("NAME", "A B", 0.97, start=0, end=3)],
        [ent("NAME", "Rahul", 0.90, start=0, end=5), ent("NAME", "Sharma", 0.80, start=6, end=12)],
        [ent("NAME", "Rahul", start=0, end=5), ent("NAME", "Sharma", start=7, end=12)],
        [ent("ADDRESS", "x", start=0, end=10), ent("ADDRESS", "y", start=12, end=20)],
        [ent("ADDRESS", "x", start=0, end=10), ent("ADDRESS", "y", start=13, end=20)],
        [ent("NAME", "X")],
        [ent("EMAIL", "a@b.co"), ent("PHONE", "9876543210", start=0, end=10)],
        [ent("DOB", "01/01/2000", 0.97, "regex", 0, 10), ent("DOB", "02/01/2000", 0.99, "deberta", 0, 9)],
        [ent("DOB", "01/01/2000", 0.97, "regex", 0, 10), ent("DOB", "02/01/2000", 0.99, "deberta", 1, 10)],
        [ent("PHONE", "+919876543210", 0.97, "regex", 0, 13), ent("AADHAAR", "919876543210", 0.97, "regex", 1, 13)],
        [ent("Date of Birth", "15/08/2004", 0.82, "llm/context"), ent("DOB", "15-08-2004", 0.97, "regex", 0, 10, 1.0)],
        [ent("VOTER_ID", "abc1234567"), ent("VOTER_ID", "ABC1234567")],
        [ent("PAN", "abcde1234f"), ent("PAN", "ABCDE1234F")],
        [ent("DRIVING_LICENCE", "XX0120230012345"), ent("PASSPORT", "Z1234567"), ent("PAN", " ")],
        [],
    ]
    got = settled(spark, cases)
    brief = [[(e["value"], round(e["confidence"], 2), e["methods_agree"]) for e in x] for x in got]
    assert brief[0] == [("ABCDE1234F", 0.97, True)] and got[0][0]["source"] == "regex"
    assert brief[1] == [("A B", 0.95, True)]
    assert brief[2] == [("Rahul Sharma", 0.80, False)] and (got[2][0]["start"], got[2][0]["end"]) == (0, 12)
    assert [len(x) for x in got[3:7]] == [2, 1, 2, 0]
    assert [e["type"] for e in got[7]] == ["PHONE", "EMAIL"]
    assert [e["value"] for e in got[8]] == ["02/01/2000"]
    assert [len(x) for x in got[9:]] == [2, 2, 1, 2, 1, 0, 0]
    assert [e["type"] for e in got[10]] == ["PHONE", "AADHAAR"]
    assert got[11][0]["source"] == "regex" and got[11][0]["methods_agree"]


def plain_reconcile(entities):
    """The same rules over dicts, written as loops."""

    def quality(e):
        return e["confidence"] + 0.30 * max(-1.0, min(e["score"], 1.0)) + (0.10 if True else 0) + (0.10 if e["agree"] else 0)

    def priority(e):
        order = {"regex": 2, "deberta": 3, "llm/context": 1} if e["type"] in ("NAME", "ADDRESS", "DOB") else {"regex": 3, "deberta": 2, "llm/context": 1}
        return order.get(e["source"], 0)

    unique = {}
    for e in entities:
        key = (e["type"], e["value"].lower())
        e = dict(e, agree=False)
        if key in unique:
            held = unique[key]
            a, b = (quality(held), priority(held), held["confidence"]), (quality(e), priority(e), e["confidence"])
            e = dict(e if b > a else held, agree=True)
        unique[key] = e
    now = list(unique.values())
    for kind, gap in (("NAME", 1), ("ADDRESS", 2)):
        merged = []
        for e in sorted((e for e in now if e["type"] == kind and e["start"] is not None), key=lambda e: e["start"]):
            if merged and e["start"] - merged[-1]["end"] <= gap:
                last = merged[-1]
                merged[-1] = dict(last, value=last["value"] + " " + e["value"], end=e["end"], confidence=min(last["confidence"], e["confidence"]), score=max(last["score"], e["score"]))
            else:
                merged.append(e)
        now = [e for e in now if e["type"] != kind] + merged
    now.sort(key=lambda e: (10**9 if e["start"] is None else e["start"], -quality(e)))
    final = []
    for e in now:
        for k in final:
            both = None not in (e["start"], k["start"]) and e["start"] < k["end"] and k["start"] < e["end"]
            if both and e["type"] == k["type"] and (e["value"].lower() == k["value"].lower() or quality(k) >= quality(e)):
                break
        else:
            final.append(e)
    return [(e["type"], e["value"], round(e["confidence"], 6), e["source"], e["start"], e["agree"]) for e in final]


def test_reconcile_equals_plain_loops(spark):
    rng = random.Random(11)
    cases, wants = [], []
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(0, 9)):
            start = rng.choice([None, *range(0, 30, 2)])
            rows.append(dict(type=rng.choice(["NAME", "ADDRESS", "EMAIL"]), value=rng.choice(["a@b.co", "c@d.co", "E@f.co"]), confidence=rng.choice([0.5, 0.75, 0.9, 0.97]), source=rng.choice(["regex", "deberta", "llm/context"]), start=start, end=None if start is None else start + rng.randint(1, 8), score=rng.choice([-1.0, 0.0, 1.0])))
        cases.append([ent(r["type"], r["value"], r["confidence"], r["source"], r["start"], r["end"], r["score"]) for r in rows])
        wants.append(plain_reconcile(rows))
    got = [[(e["type"], e["value"], round(e["confidence"], 6), e["source"], e["start"], e["methods_agree"]) for e in x] for x in settled(spark, cases)]
    assert got == wants


def test_fold_and_phones_over_all_rows(spark):
    where = "/root/testdata/sf0.001"
    by_doc = defaultdict(list)
    for r in sorted(queries.built(spark, where, queries.LINES).collect(), key=lambda r: (r["doc_id"], r["ord"])):
        by_doc[r["doc_id"]].append(r)
    order = {"regex": 2, "deberta": 3, "llm/context": 1}
    want, crowded = Counter(), 0
    for key, found in by_doc.items():
        held = {}
        for r in found:
            new = (float(r["confidence"]), float(r["score"]), r["source"], False)
            if r["value"] in held:
                crowded += held[r["value"]][3]
                rank = lambda e: (round(e[0] + 0.3 * e[1] + 0.1 + 0.1 * e[3], 9), order.get(e[2], 0), e[0])
                new = (*max(held[r["value"]], new, key=rank)[:3], True)  # the holder stays where both are equal
            held[r["value"]] = new
        want.update((key, value, e[3], e[2]) for value, e in held.items())
    assert crowded > 50  # values seen three times and more
    assert Counter(tuple(r) for r in queries.QUERIES["dedup_methods_agree"](spark, where).collect()) == want
    raw = queries.built(spark, where, queries.RAW).collect()
    plain = {}
    for r in raw:
        digits = re.sub(r"\D", "", r["value"])
        plain[r["id"]] = digits[2:] if len(digits) == 12 and digits.startswith("91") else digits
    got = {r["id"]: r["c"] for r in queries.QUERIES["normalize_phone"](spark, where).collect()}
    assert got == plain and len(got) == spark.read.parquet(f"{where}/customer.parquet").count()


CONFIDENCE = [
    ("regex", 0.97, True, False, 0.95, "high"), ("regex", 0.97, True, True, 1.0, "high"), ("ocr+regex", 0.1, True, False, 0.85, "medium"), ("ocr+regex", 0.1, True, True, 0.95, "high"),
    ("deberta", 0.83, True, False, 0.88, "medium"), ("deberta", 0.95, True, True, 1.0, "high"), ("nlp", 0.0, True, False, 0.70, "medium"), ("llm/context", 0.82, True, False, 0.87, "medium"),
    ("llm/context", 0.82, True, True, 0.97, "high"), ("multiple", 0.9, False, False, 0.50, "low"), ("multiple", 0.9, True, False, 0.60, "low"),
]


def test_confidence(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CONFIDENCE)], "i int, s string, c double, v boolean, a boolean")
    score = scoring.final_confidence(F.col("s"), F.col("c"), F.col("v"), F.col("a"))
    for r in df.select("i", score.alias("x"), scoring.confidence_level(score).alias("l")).collect():
        assert (r["x"], r["l"]) == CONFIDENCE[r["i"]][4:]


def test_routing(spark):
    cases = [
        ([ent("PAN", "A"), ent("PAN", "B")], True),
        ([ent("EMAIL", "a", 0.9, score=1.0, role="primary"), ent("EMAIL", "b", 0.9, score=1.0, role="primary")], True),
        ([ent("EMAIL", "a", 0.9, score=1.0, role="primary"), ent("EMAIL", "b", 0.9)], False),
        ([ent("NAME", "a", 0.9, score=1.0, role="primary"), ent("NAME", "b", 0.9)], False),
        ([ent("NAME", "a", 0.9, score=1.0, role="primary"), ent("NAME", "b", 0.9, score=1.0, role="primary")], True),
        ([ent("NAME", "a", 0.75)], True),
        ([ent("NAME", "a", 0.60, role="non_target")], False),
        ([], False),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, e array<{ENTITY}>")
    for r in df.select("i", route.needs_llm(F.col("e")).alias("x")).collect():
        assert r["x"] == cases[r["i"]][1]


def test_pipeline_stays_in_its_rows_and_uses_plug_ins(spark):
    df = spark.createDataFrame([(1, "Name\nAsha Nair\nPAN ABCDE1234F or PQRST9876Z"), (2, ""), (3, None)], "doc_id bigint, text string")
    plain = pipeline.extract(df)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    rows = {r["doc_id"]: r for r in plain.collect()}
    assert [e["type"] for e in rows[1]["entities"]] == ["PAN", "PAN"] and rows[2]["status"] == rows[3]["status"] == "no_text"

    def ner(texts):
        return [[{"label": "B-NAME", "score": 0.91, "start": 5, "end": 9}, {"label": "I-NAME", "score": 0.88, "start": 10, "end": 14}] if t else [] for t in texts]

    def llm(texts):
        assert all("PAN" in t for t in texts)
        return ['{"entities": [{"type": "Date of Birth", "value": "1/1/2000"}]}' for _ in texts]

    def roles(contexts):
        return [("organization", 0.8765) if "asha" in c else ("nothing", None) for c in contexts]

    full = {r["doc_id"]: [(e["type"], e["value"], e["confidence"]) for e in r["entities"]] for r in pipeline.extract(df, ner=ner, llm=llm).collect()}
    learned = pipeline.extract(df.where("doc_id = 1"), roles=roles).first()["entities"]
    assert [(e["context_role"], e["context_score"], e["context_model"]) for e in learned] == [("non_target", -0.877, "learned")] * 2
    assert ("NAME", "Asha Nair", 0.93) in full[1] and ("DOB", "1/1/2000", 0.87) in full[1] and full[2] == []

    def broken(texts):
        raise RuntimeError("no model")

    row = pipeline.extract(df.where("doc_id = 1"), ner=broken).first()
    assert [e["type"] for e in row["entities"]] == ["PAN", "PAN"] and row["errors"] == ["ner: RuntimeError"]
    assert pipeline.redact(plain.where("doc_id = 1")).first()["redacted"] == "Name\nAsha Nair\nPAN [PAN] or [PAN]"


def test_models_see_a_text_once_and_a_bad_text_costs_only_itself(spark, tmp_path):
    rows = [(i, f"Name\nAsha Nair\nPAN ABCDE123{i % 10}F or PQRST987{i % 10}Z" if i % 2 else f"nothing {i}") for i in range(40)]
    df = spark.createDataFrame([*rows, (40, "bad text"), (41, None)], "doc_id bigint, text string").coalesce(2)
    seen = str(tmp_path / "seen")

    def ner(texts):
        if "bad text" in texts:
            raise ValueError("no")
        with open(seen, "a") as f:
            f.writelines(f"ner {t!r}\n" for t in texts)
        return [[{"label": "B-NAME", "score": 0.95, "start": 5, "end": 9}] if "Asha" in t else [] for t in texts]

    def llm(texts):
        with open(seen, "a") as f:
            f.writelines(f"llm {t!r}\n" for t in texts)
        return ['{"entities": []}' for _ in texts]

    out = {r["doc_id"]: r for r in pipeline.extract(df, ner=ner, llm=llm).collect()}
    counts = Counter(open(seen).read().splitlines())
    wanted = Counter([f"ner {t!r}" for _, t in rows] + [f"llm {t!r}" for i, t in rows if i % 2])
    assert counts == wanted
    assert out[40]["errors"] == ["ner: ValueError"] and all(not out[i]["errors"] for i in range(40)) and out[41]["status"] == "no_text"
    assert all(("NAME" in {e["type"] for e in out[i]["entities"]}) == bool(i % 2) for i in range(40))


def test_running_values_and_runs(spark):
    for n in (0, 1, 5, 127, 128, 129, 1000):
        xs = [i * 7 % 11 for i in range(n)]
        row = spark.createDataFrame([(xs,)], "x array<int>").select(text.running(F.col("x"), F.lit(0), lambda a, b: a + b).alias("s"), text.runs(F.col("x"), lambda i: F.col("x")[i] < F.col("x")[i - 1]).alias("r")).first()
        assert row["s"] == [sum(xs[:i]) for i in range(n)]
        assert [x for r in row["r"] for x in r] == xs and all(list(r) == sorted(r) and len(r) for r in row["r"])


def test_long_lists_are_extracted_in_seconds(spark):
    numbers = [f"9{i:09d}" for i in range(10_000)]
    doc = "Phones\n" + "\n".join(numbers * 1) + "\n" + " ".join(f"u{i}@mail.example" for i in range(3_000))
    begin = time.time()
    found = pipeline.extract(spark.createDataFrame([(1, doc)], "doc_id bigint, text string")).first()["entities"]
    assert time.time() - begin < 90
    assert [e["value"] for e in found if e["type"] == "PHONE"] == numbers and len(found) == 13_000
    assert all(doc[e["start"] : e["end"]] == e["value"] for e in found)


def test_result_schema_and_observed_counts(spark):
    from pyspark.sql import Observation

    df = pipeline.extract(spark.createDataFrame([(1, "a@b.co"), (2, None)], "doc_id bigint, text string"))
    assert df.select("entities", "status").schema.simpleString() == spark.createDataFrame([], pipeline.RESULT).schema.simpleString()
    seen = Observation()
    pipeline.observed(df, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"documents": 2, "entities": 1, "no_text": 1}


def test_bio_decode_closes_and_skips(spark):
    tokens = [("O", 0.9, 0, 0), ("B-NAME", 0.9, 0, 4), ("I-NAME", 0.81234, 5, 9), ("O", 0.9, 10, 11), ("I-NAME", 0.7, 12, 14), ("I-PAN", 0.6, 15, 18), ("B-PAN", 0.5, 19, 22), ("X", 0.4, 23, 24), ("I-PAN", 0.3, 25, 26)]
    df = spark.createDataFrame([(tokens,)], "t array<struct<label:string,score:double,start:int,end:int>>")
    got = [tuple(e) for e in df.select(extract.bio_decode(F.col("t")).alias("x")).first()["x"]]
    assert got == [("NAME", 0, 9, 0.8123), ("NAME", 12, 14, 0.7), ("PAN", 15, 18, 0.6), ("PAN", 19, 22, 0.5), ("PAN", 25, 26, 0.3)]


def test_llm_replies_and_places(spark):
    text_ = "Full name: Asha\n Nair (x)"
    cases = ['{"entities": [{"type": "Name", "value": "asha nair"}]}', 'ok {"entities": [{"type": "Name", "value": "(X)"}]} bye', "[]", "junk", '{"entities": [{"type": "Name", "value": "none"}]}', None]
    df = spark.createDataFrame([(i, text_, r) for i, r in enumerate(cases)], "i int, t string, r string")
    got = {r["i"]: [(c["value"], c["start"], c["end"]) for c in r["c"]] for r in df.select("i", extract.llm_candidates(F.col("t"), F.col("r")).alias("c")).collect()}
    assert got == {0: [("asha nair", 11, 21)], 1: [("(X)", 22, 25)], 2: [], 3: [], 4: [("none", None, None)], 5: []}


def test_llm_list(spark):
    df = spark.createDataFrame([('x [{"type": "PAN", "value": "A", "confidence": 0.5}, {"type": "", "value": "B"}, {"type": "NAME", "value": "C"}] y',), ("none",), (None,)], "r string")
    got = [[(e["type"], e["value"], e["confidence"], e["source"]) for e in r["c"]] for r in df.select(extract.llm_list(F.col("r")).alias("c")).collect()]
    assert got == [[("PAN", "A", 0.5, "llm"), ("NAME", "C", 0.85, "llm")], [], []]


def test_llm_endpoint_that_is_away_gives_no_reply():
    from formsift.sources.llm_http import HttpLlm

    assert HttpLlm(url="http://127.0.0.1:9", timeout=0.5)(["a", None]) == [None, None]


def test_values(spark):
    df = spark.createDataFrame([("31/02/2000", "1-2-1999", "15/08-2004", "+91 98765 43210", "919876543210")], "a string, b string, c string, d string, e string")
    row = df.select(*[text.normalize_dob(F.col(c)).alias(c) for c in "abc"], *[text.normalize_phone(F.col(c)).alias(c) for c in "de"]).first()
    assert tuple(row) == ("31/02/2000", "1999-02-01", "15/08-2004", "9876543210", "9876543210")


def test_evaluation_of_two_documents(spark):
    gold = spark.createDataFrame([(1, "Email", "a@b.co"), (1, "Phone", "9876543210"), (1, "Name", "R S"), (2, "PAN", "ABCDE1234F"), (2, "Phone", "9876543211"), (2, "Name", "P D")], "doc_id int, type string, value string")
    texts = spark.createDataFrame([(1, "a@b.co 9876543210"), (2, "ABCDE1234F, 9876543211")], "doc_id int, text string")
    found = texts.select("doc_id", F.explode(extract.regex_candidates(F.col("text"))).alias("c")).select("doc_id", "c.type", "c.value")
    keys = [evaluate.key_set(x, by=lambda k, v: evaluate.simple_value(v)) for x in (gold, found)]
    row = evaluate.metrics(evaluate.outcomes(*keys)).where("level = 'overall'").first()
    assert (row["tp"], row["fp"], row["fn"]) == (4, 0, 2) and round(row["recall"], 3) == 0.667 and row["f1"] == 0.8
    none = evaluate.metrics(evaluate.outcomes(*[k.limit(0) for k in keys])).where("level = 'overall'").first()
    assert (none["tp"], none["precision"], none["f1"]) == (0, 0.0, 0.0)


def test_order_statistics_with_infinite_values(spark, monkeypatch):
    monkeypatch.setattr(analytics, "RANKED_ROWS", 3)
    values = [float("-inf")] * 2 + [-1e308, 1.0, 2.0, 2.0, 5.0, 1e308] + [float("inf")] * 3 + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [analytics.nth_value(df, "v", i, bins=4) for i in range(len(values))]
    assert str(got) == str(values) and analytics.nth_value(df, "v", len(values)) is None


#: A token that holds a phone by its pattern, beside an e-mail; an e-mail twice; nothing.
MIXED = [(1, 'token = "9885103314b39ed955fd8ac9" mail a.b@post.example'), (2, "x@y.example or X@y.example, 9876543210"), (3, " "), (4, None)]


def matches_sql(spark, name, path):
    """Whether a query gives its SQL's rows over MIXED as the table documents; its rows."""
    import duckdb

    spark.createDataFrame(MIXED, "doc_id bigint, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(path)).collect())
    assert got == sorted(con.execute(queries.ORACLES[name]).fetchall())
    return got


def test_document_analytics_count_the_types_asked_for(spark, tmp_path):
    mails = matches_sql(spark, "doc_analytics", tmp_path)
    assert mails == [(1, "success", 1, 1, 0, 0), (2, "success", 1, 1, 0, 0), (3, "no_text", 0, 0, 0, 0), (4, "no_text", 0, 0, 0, 0)]
    assert [r[2] for r in matches_sql(spark, "doc_analytics_all", tmp_path)] == [2, 2, 0, 0]


def test_report_lines_are_of_the_types_asked_for(spark, tmp_path):
    assert matches_sql(spark, "report_lines", tmp_path) == [(1, "EMAIL", 1), (2, "EMAIL", 1)]
    lines = [r[:4] for r in matches_sql(spark, "report_lines_all", tmp_path)]
    assert lines == [(1, 0, "PHONE", "9885103314"), (1, 1, "EMAIL", "a.b@post.example"), (2, 0, "EMAIL", "x@y.example"), (2, 1, "PHONE", "9876543210")]


def test_batch_analytics_sum_the_types_asked_for(spark, tmp_path):
    assert matches_sql(spark, "batch_analytics", tmp_path) == [(4, 2, 2, 0, 0)]
    assert matches_sql(spark, "batch_analytics_all", tmp_path) == [(4, 4, 4, 0, 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 150])
def test_order_statistics(spark, n):
    df = spark.createDataFrame([(float(i),) for i in range(n)], "v double")
    row = analytics.order_statistics(df, "v").first()
    assert row["n"] == n and (row["median"], row["p95"]) == ((None, None) if not n else (float(n // 2), float(min(n - 1, int(0.95 * n)))))


def test_synthetic_forms(spark):
    forms = synth.generate(spark, 400)
    rows = forms.collect()
    again = {r["document_id"]: r["text"] for r in synth.generate(spark, 400).repartition(7).collect()}
    assert len({r["document_type"] for r in rows}) == len(vocab.LAYOUTS)
    for r in rows:
        assert again[r["document_id"]] == r["text"]
        assert all(r["text"][e["start"] : e["end"]] == e["value"] for e in r["entities"])
    clean = {r["document_id"]: r["text"] for r in synth.generate(spark, 400, noise=False).collect()}
    changed = sum(clean[r["document_id"]] != r["text"] for r in rows)
    assert 0.3 < changed / 400 < 0.7
    split = synth.exact_split(forms, "document_id", {"train": 320, "validation": 40, "test": 40}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 320, "validation": 40, "test": 40}
    few = synth.exact_split(spark.range(3000), "id", {"a": 0, "b": 1500, "c": 1499}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in few} == {"b": 1500, "c": 1499, None: 1}
    assert synth.exact_split(spark.range(0), "id", {"a": 5}).count() == 0
    two = prep.train_split(spark.range(101), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in two} == {"train": 90, "validation": 11}


def test_token_labels(spark):
    entities = [(0, 4, "NAME"), (5, 9, "JOB"), (6, 12, "PAN")]
    offsets = [(0, 0), (0, 2), (2, 4), (4, 5), (5, 8), (8, 12), (12, 12)]
    df = spark.createDataFrame([("abcdefghijklmn", entities, offsets)], "text string, e array<struct<start:int,end:int,label:string>>, o array<struct<start:int,end:int>>")
    known = F.filter("e", lambda e: e["label"] != "JOB")
    row = df.select(prep.character_labels(F.col("text"), F.col("e")).alias("c"), prep.token_labels(F.col("o"), known).alias("t"), prep.token_labels_by_first(F.col("o"), F.col("e")).alias("f")).first()
    assert row["c"][:7] == ["B-NAME", "I-NAME", "I-NAME", "I-NAME", "O", "O", "B-PAN"] and len(row["c"]) == 14
    assert row["t"] == [-100, 1, 2, 0, 3, 4, -100] and row["f"] == [-100, 1, 2, 0, 3, 4, -100]
    assert df.select(prep.character_labels(F.lit(""), F.col("e"))).first()[0] == []


def docx(*paragraphs, table=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p(paragraphs[0])}<w:tbl>{rows}</w:tbl>{''.join(map(p, paragraphs[1:]))}</w:body></w:document>")
    return out.getvalue()


def xlsx():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c/><c><v>12</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>PAN</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_whole_texts_are_labelled(spark):
    where = "/root/testdata/sf0.001"
    forms = {r["doc_id"]: (len(r["text"]), r["place"]) for r in queries.built(spark, where, queries.LABELLED).collect()}
    assert any(place > 90 for _, place in forms.values())
    chars, tokens = defaultdict(dict), defaultdict(dict)
    for r in queries.QUERIES["bio_char_labels"](spark, where).collect():
        chars[r["doc_id"]][r["pos"]] = r["label"]
    for r in queries.QUERIES["token_label_align"](spark, where).collect():
        tokens[r["doc_id"]][r["pos"]] = r["label"]
    for key, (n, place) in forms.items():
        assert sorted(chars[key]) == list(range(n)) and sorted(tokens[key]) == list(range((n + 2) // 3))
        assert {p: x for p, x in chars[key].items() if x.endswith("EMAIL")} == {p: "I-EMAIL" if p > place else "B-EMAIL" for p in range(place, place + 8)}
        meets = {i for i in range((n + 2) // 3) if i % 10 != 9 and i * 3 < place + 8 and min(i * 3 + 3, n) > place}
        assert {i for i, x in tokens[key].items() if x in (7, 8)} == meets


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("Name: Asha", "Mobile 9876543210", table=[("PAN", "ABCDE1234F"), ("", "x")]))
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.png").write_bytes(b"image")
    (tmp_path / "d.txt").write_bytes(b"text")
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.png").write_bytes(b"")
    found = files.read_documents(spark, str(tmp_path))
    assert files.accepted(found).count() == 5
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.docx").write_bytes(docx("another of that name"))
    again = files.accepted(files.read_documents(spark, str(tmp_path)), needed=True).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in again) == ["a.docx", "b.xlsx", "c.png", "e.docx", "f.pdf"] and not any("more" in r["path"] for r in again)
    with pytest.raises(ValueError, match="no supported"):
        files.accepted(found.where("path like '%.txt'"), needed=True)

    def away(path, content):
        raise RuntimeError("no engine")

    assert files.load_one("x.png", b"i", ocr=[away, lambda p, b: [" "], lambda p, b: ["third"], lambda p, b: ["fourth"]])[0] == "third"
    assert files.load_one("x.png", b"i", ocr=away)[3] == "failed"
    loaded = files.load_documents(found, pdf=lambda b: ["", "short"], ocr=lambda p, b: ["", "read by OCR"])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in loaded.collect()}
    assert rows["a.docx"]["text"] == "Name: Asha\nMobile 9876543210\nPAN | ABCDE1234F\nx"
    assert rows["b.xlsx"]["text"] == "Sheet: One\nName | 12\nPAN"
    assert rows["c.png"]["text"] == "read by OCR" and rows["c.png"]["needs_ocr"]
    assert rows["f.pdf"]["text"] == "Page 2\nread by OCR"
    assert rows["d.txt"]["status"] == "rejected" and rows["e.docx"]["status"] == "failed" and "g.png" not in rows


def test_ocr_parts(spark):
    df = spark.createDataFrame([([(" a ", 0.5), ("", 0.1), ("b", 1.0)],)], "x array<struct<text:string,score:double>>")
    assert tuple(df.select(files.ocr_lines(F.col("x")).alias("o")).first()["o"]) == ("a\nb", 0.75)
    pages = spark.createDataFrame([("p", 10, "ten"), ("p", 2, "two"), ("p", 3, " ")], "path string, page int, text string")
    assert files.page_texts(pages).first()["text"] == "Page 2\ntwo\nPage 10\nten"
    assert spark.range(1).select(files.first_text(F.lit(" "), F.lit(None).cast("string"), F.lit("x"))).first()[0] == "x"
    card = "Government of India\nName\nRahul Sharma\nDOB 01/02/1990 MALE\n1234 5678 9012"
    assert spark.range(1).select(text.ocr_score(F.lit(card))).first()[0] == 50 + 35 + 30 + 15 + 10 + 20 + 10 + 5 + 5
    assert spark.range(1).select(text.ocr_score(F.lit(""))).first()[0] == 0


def test_tables_in_and_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "one", "entities": [{"start": 0, "end": 3, "label": "NAME"}]}]')
    (tmp_path / "b.json").write_text('[{"text": "two", "entities": []}]')
    both = files.read_examples(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).orderBy("text").collect()
    assert [r["text"] for r in both] == ["one", "two"] and both[0]["entities"][0]["label"] == "NAME"
    (tmp_path / "c.csv").write_text('Name,Address\nAsha,"1, ""Hill"" Road\nKochi"\n')
    assert tuple(files.read_csv(spark, str(tmp_path / "c.csv")).first()) == ("Asha", '1, "Hill" Road\nKochi')
    files.write_splits(synth.exact_split(spark.range(10), "id", {"train": 8, "test": 2}), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "split=train")).count() == 8
    box = spark.range(1).select(files.regions(F.lit(1000), F.lit(500)).alias("r")).first()["r"]
    assert [tuple(b) for b in box] == [(40, 110, 680, 335), (40, 250, 680, 495)]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.co", "2026-01-01 00:01:00"), (2, "x", "2026-01-01 00:02:00")], "doc_id bigint, text string, at string").withColumn("at", F.to_timestamp("at"))
    docs.write.parquet(f"{tmp_path}/in")
    flow = stream.extract_stream(stream.read_stream(spark, f"{tmp_path}/in"))
    stream.write_stream(flow, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/analytics").agg(F.sum("total")).first()[0] == 1
    # The mark of the finished batch is lost, so it runs again: no row twice.
    for name in os.listdir(f"{tmp_path}/mark/commits"):
        os.remove(f"{tmp_path}/mark/commits/{name}")
    stream.write_stream(flow, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/entities").count() == 2
    assert stream.windowed_counts(stream.extract_stream(docs)).first()["entities"] == 1
