"""Secret scans by grammar inference.

1. A first pass over whole texts finds the base rules' matches (leftmost, not
   overlapping within a kind) and the candidates: every run of 12 or more
   credential letters, whatever it holds and wherever it stands, without full
   stops at its end. Each task keeps the labelled strings with the smallest hashes
   and counts the characters of all other candidates in context.
2. Labelled credentials (the base matches, and strings drawn from published
   token formats) are read into one prefix tree per kind, over classes of
   characters. States whose endings and continuations agree within the Hoeffding
   bound, and so on below them, are merged: a probabilistic automaton. The
   background is an automaton too, with one state for each two last classes; its
   counts are of all candidates of the corpus that hold no base match and don't
   look like a published format.
3. A second pass scores every candidate by each format's likelihood. It is a secret
   if a format beats the background by MARGIN nats and finds it as likely a letter
   as its own labelled strings are. Its span is added unless a base match covers
   it: a base match inside a longer credential stays and the whole gets a span.

Training reads at most MAX_LABELLED labelled strings a kind, those with the
smallest hashes of all distinct ones (a documented bound); all else covers every
row. Offsets are code points, ends exclusive. Spans that begin together stand in
the order assign, access, hex, learned. Null text counts as empty; texts of any
length are scanned whole; repeated rows and equal tokens are found each; an empty
table gives an empty result; columns of any names stay."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formsift.llm.bpe import slices
from formsift.llm.common import fresh, prepare, staged

#: Base rules: kind, pattern, group that must have least so many characters, that number (fixed values).
BASE = (
    ("assign", re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: The same, faster: in a run of these letters a shorter match leaves none that is long enough.
QUICK = {"access": re.compile(r"AKIA[A-Z0-9]{14,}"), "hex": re.compile(r"[0-9a-f]{16,}")}
ORDER = {"assign": 0, "access": 1, "hex": 2, "learned": 3}
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.-]{{{LEAST},}}={{0,2}}")
#: Published token formats: fixed starts, then parts of so many letters of a kind (fixed values).
DIGITS = "0123456789"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMATS = {
    "github": (("ghp_", "gho_", "ghs_"), [((ALNUM, 36),)]),
    "gitlab": (("glpat-",), [((ALNUM + "-_", 20),)]),
    "google": (("AIza",), [((ALNUM + "-_", 35),)]),
    "slack": (("xoxb-", "xoxp-"), [((DIGITS, n), ("-", 1), (DIGITS, m), ("-", 1), (ALNUM, 24)) for n in (10, 11, 12, 13) for m in (10, 11, 12, 13)]),
    "stripe": (("sk_live_", "rk_live_"), [((ALNUM, 24),), ((ALNUM, 32),)]),
}
STARTS = tuple(s for starts, *_ in FORMATS.values() for s in starts)
MAX_LABELLED, PER_FORMAT = 400, 320
ALPHA, MARGIN, SLACK, UNSEEN = 0.05, math.log(1000), 0.15, 1e-4

CLASS = {c: name for name, letters in (("d", "0123456789"), ("x", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("X", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in letters}
WIDTH = {"d": 10, "x": 6, "l": 20, "X": 6, "U": 20}


def published(per_format: int = PER_FORMAT) -> list[tuple[str, str]]:
    """Labelled strings of the published formats, the same at each call."""
    out = []
    for kind, (starts, shapes) in FORMATS.items():
        for i in range(per_format):
            seed = hashlib.sha512(f"{kind}/{i}".encode()).digest()
            word, at = starts[i % len(starts)], 0
            for letters, n in shapes[i // len(starts) % len(shapes)]:
                word += "".join(letters[b % len(letters)] for b in seed[at : at + n])
                at += n
            out.append((kind, word))
    return out


class Automaton:
    """Probabilistic automaton merged from a prefix tree (red and blue states)."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        self.ends, self.total = [0], [0]
        for word in sorted(words):
            at = 0
            for c in word:
                s = CLASS.get(c, c)
                self.total[at] += 1
                self.seen[at][s] += 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                    self.ends.append(0)
                    self.total.append(0)
                at = self.next[at][s]
            self.total[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._log()

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differs(self.ends[a], self.total[a], self.ends[b], self.total[b]):
                return False
            for s in {*self.seen[a], *self.seen[b]}:
                if self._differs(self.seen[a].get(s, 0), self.total[a], self.seen[b].get(s, 0), self.total[b]):
                    return False
                if s in self.next[a] and s in self.next[b] and self.next[a][s] != self.next[b][s]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add tree b to state a, and so on along its branches."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for s, n in self.seen[b].items():
                self.seen[a][s] += n
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            inside = set(red)
            blue = [(r, s, b) for r in red for s, b in sorted(self.next[r].items()) if b not in inside]
            if not blue:
                break
            r, s, b = max(blue, key=lambda x: (self.total[x[2]], -x[0]))
            for q in red:
                if self._compatible(q, b):
                    self.next[r][s] = q
                    self._fold(q, b)
                    break
            else:
                red.append(b)
        number = {q: i for i, q in enumerate(red)}
        self.next = [{s: number[b] for s, b in self.next[q].items()} for q in red]
        self.seen = [dict(self.seen[q]) for q in red]
        self.ends, self.total = [self.ends[q] for q in red], [self.total[q] for q in red]

    def _log(self) -> None:
        self.step = [{s: math.log(n / t) - math.log(WIDTH.get(s, 1)) for s, n in seen.items()} for seen, t in zip(self.seen, self.total)]
        self.stop = [math.log(max(e / t, UNSEEN)) if t else math.log(UNSEEN) for e, t in zip(self.ends, self.total)]

    def score(self, word: str) -> float:
        """Log likelihood; a step never seen costs UNSEEN and stays in its state."""
        at, total = 0, 0.0
        for c in word:
            s = CLASS.get(c, c)
            step = self.step[at].get(s)
            total += math.log(UNSEEN) - math.log(WIDTH.get(s, 1)) if step is None else step
            at = self.next[at].get(s, at)
        return total + self.stop[at]


class Background:
    """Automaton of all candidates: a state for each two last classes, the end is a class."""

    def __init__(self, counts: dict[str, int]):
        total: dict[str, int] = defaultdict(int)
        for key, n in counts.items():
            total[key[:2]] += n
        kinds = len(WIDTH) + len("+/_.-=$")
        self.step = {k: math.log((n + 0.5) / (total[k[:2]] + 0.5 * kinds)) - math.log(WIDTH.get(k[2], 1)) for k, n in counts.items()}
        self.rare = {k: math.log(0.5 / (n + 0.5 * kinds)) for k, n in total.items()}
        self.never = -math.log(kinds)

    def score(self, word: str) -> float:
        total = 0.0
        for key in triples(word):
            found = self.step.get(key)
            total += self.rare.get(key[:2], self.never) - math.log(WIDTH.get(key[2], 1)) if found is None else found
        return total


def triples(word: str) -> list[str]:
    """Each class of the word with the two before it; ^ stands before and $ after it."""
    classes = f"^^{''.join([CLASS.get(c, c) for c in word])}$"
    return [classes[i : i + 3] for i in range(len(classes) - 2)]


class Grammar:
    """Automata of all formats, each with its least score a letter, and the background."""

    def __init__(self, labelled: dict[str, list[str]], background: dict[str, int]):
        self.formats = {}
        for kind, words in sorted(labelled.items()):
            if len(words) >= 5:
                automaton = Automaton(words)
                scores = sorted(automaton.score(w) / len(w) for w in words)
                self.formats[kind] = (automaton, scores[len(scores) // 50] - SLACK)
        self.background = Background(background)

    def like(self, word: str) -> bool:
        """Whether a format finds the word as likely as its own."""
        return any(a.score(word) / len(word) >= least for a, least in self.formats.values())

    def secret(self, word: str) -> bool:
        base = self.background.score(word)
        for automaton, least in self.formats.values():
            score = automaton.score(word)
            if score - base > MARGIN and score / len(word) >= least:
                return True
        return False


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by start, then kind as listed."""
    found = []
    for kind, pattern, group, least in BASE:
        if kind == "access" and "AKIA" not in text:
            continue
        for m in QUICK.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end(), m[group]))
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of each run of credential letters."""
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0].rstrip(".")
        if len(word) >= LEAST:
            out.append((m.start(), m.start() + len(word), word))
    return out


def rank(value: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(value.encode("utf-8", "surrogatepass"))


class Gathered:
    """What training takes from texts: the labelled strings of least rank, and
    counts of triples of all unlabelled candidates. Bounded whatever it reads."""

    def __init__(self, known: Grammar, most: int):
        self.known, self.most = known, most
        self.labelled: dict[str, dict[str, int]] = {kind: {} for kind, *_ in BASE}
        self.words: dict[str, int] = defaultdict(int)
        self.counts: dict[str, int] = defaultdict(int)

    def add(self, text: str) -> None:
        base = base_matches(text)
        for kind, _, _, value in base:
            kept = self.labelled[kind]
            if value not in kept:
                kept[value] = rank(value)
                if len(kept) >= 2 * self.most + 100:
                    self._trim(kind)
        at = 0
        ends = sorted((s, e) for _, s, e, _ in base)
        for start, end, word in candidates(text):
            while at < len(ends) and ends[at][1] <= start:
                at += 1
            if at == len(ends) or ends[at][0] >= end:
                self.words[word] += 1
        if len(self.words) > 50_000:
            self.settle()

    def _trim(self, kind: str) -> None:
        self.labelled[kind] = dict(sorted(self.labelled[kind].items(), key=lambda x: (x[1], x[0]))[: self.most])

    def settle(self) -> None:
        for word, n in self.words.items():
            if not (word.startswith(STARTS) and self.known.like(word)):
                for key in triples(word):
                    self.counts[key] += n
        self.words.clear()

    def rows(self) -> list[tuple[str, str, int]]:
        """(kind, string, rank) of labelled strings and ("", triple, count)."""
        self.settle()
        for kind in self.labelled:
            self._trim(kind)
        return [(kind, v, r - (1 << 63)) for kind, kept in self.labelled.items() for v, r in kept.items()] + [("", k, n) for k, n in self.counts.items()]


def published_grammar() -> tuple[dict[str, list[str]], Grammar]:
    known: dict[str, list[str]] = defaultdict(list)
    for kind, word in published():
        known[kind].append(word)
    return known, Grammar(known, {})


def fit(df: DataFrame, text: str = "text", most: int = MAX_LABELLED) -> Grammar:
    """Automata from the labelled credentials and the background of all texts."""
    prepare(df.sparkSession)

    def run(batches):
        gathered = Gathered(published_grammar()[1], most)
        for batch in batches:
            for part in slices(batch):
                for t in part.column(0).to_pylist():
                    gathered.add(t or "")
        rows = gathered.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["kind", "value", "n"])

    found = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind string, value string, n bigint")
    # At most `most` strings a kind and task, and as many triples as there are classes.
    found = staged(found, "gathered")
    least = lambda kind: found.where(F.col("kind") == kind).select("n", "value").distinct().orderBy("n", "value").limit(most).collect()
    labelled = {kind: [r["value"] for r in least(kind)] for kind, *_ in BASE}
    counts = found.where("kind = ''").groupBy("value").agg(F.sum("n").alias("n")).collect()
    return Grammar(labelled | published_grammar()[0], {r["value"]: r["n"] for r in counts})


SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SECRETS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
MASK, IN_WORD = "[SECRET]", frozenset(ALNUM + "_-")


def masked(text: str, spans: list[dict]) -> str:
    """text with each stretch that spans cover replaced by MASK. A run of hex digits
    or an access key inside a longer word takes the whole word with it."""
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        start, end = s["start"], s["end"]
        if s["kind"] in ("hex", "access"):
            while start > at and text[start - 1] in IN_WORD:
                start -= 1
            end = max(end, at)
            while end < len(text) and text[end] in IN_WORD:
                end += 1
        if end <= at:
            continue
        if start >= at and not (out and start == at):
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_of(text: str, secret) -> list[dict]:
    """All spans of a text; secret: whether a word is one."""
    base = base_matches(text)
    found = [(kind, start, end) for kind, start, end, _ in base]
    ends = sorted((s, e) for _, s, e in found)
    at = 0
    for start, end, word in candidates(text):
        while at < len(ends) and ends[at][1] < end:
            at += 1
        if (at == len(ends) or ends[at][0] > start) and secret(word):
            found.append(("learned", start, end))
    found.sort(key=lambda x: (x[1], ORDER[x[0]]))
    return [{"kind": k, "start": s, "end": e} for k, s, e in found]


def find_secrets(df: DataFrame, keep: list[str], text: str = "text", grammar: Grammar | None = None, mask: bool = False, name: str = "secrets") -> DataFrame:
    """The columns in keep and one more, name: (kind, start, end) by start, then kind.

    mask: the text, if it is kept, comes back with its secrets replaced by MASK."""
    prepare(df.sparkSession)
    grammar = grammar or fit(df, text)
    sent = keep if text in keep else [*keep, text]
    at = sent.index(text)
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(sent)])
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("found", SECRETS)])

    def run(batches):
        known: dict[str, bool] = {}

        def secret(word):
            if word not in known:
                if len(known) > 100_000:
                    known.clear()
                known[word] = grammar.secret(word)
            return known[word]

        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                found = [spans_of(t or "", secret) for t in texts]
                columns = list(part.columns[: len(keep)])
                if mask and text in keep:
                    columns[at] = pa.array([masked(t, s) if s else t for t, s in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, SECRETS_ARROW)], schema.names)

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("found").alias(name))


def mask_secrets(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """df with the secrets of its text replaced by MASK; a column of that name
    (if there is one) gets the new length. All columns stay."""
    [name] = fresh(df, "secrets")
    found = find_secrets(df, df.columns, text, mask=True, name=name)
    new = F.length(f"`{text}`")
    return found.select(*[new.cast(df.schema[c].dataType).alias(c) if c == length else F.col(f"`{c}`") for c in df.columns])


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, all spans, and how many were learned."""
    found = find_secrets(docs, ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] != "learned")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("learned").alias("n_learned"),
    )
