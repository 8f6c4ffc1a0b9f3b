"""Secrets: fixed patterns, and candidates that a grammar inferred from labelled credentials finds likely.

Grammar inference: the labelled credentials of a format form a prefix tree. A state that all of its (eight or more)
examples leave by one character keeps that character; elsewhere the tree branches by classes of characters. States are
merged when their shares of ending and of each next symbol don't differ by Hoeffding's bound, and so do those of their
successors; of several compatible states the closest is taken. The tree becomes a probabilistic automaton: `ghp_` stays
as it is, the random rest becomes a loop. A candidate is a piece of a run of credential characters, of any length, without marks at its ends,
cut at '='. Its score is the greatest log likelihood under a credential's automaton, less the greatest under the automata
of ordinary formats (words, identifiers, numbers, versions, UUIDs, digests, paths), a character. Candidates that score above
THRESHOLD are secrets of the kind `inferred`. All are scored, but for those that lie within a base span; base spans always stay.

The labelled credentials are the base matches in a sample of documents (about SAMPLE_DOCS of them, chosen by a hash
of their id and text; PER_DOC matches of each, PER_KIND values of a kind) and generated examples of published formats. Candidates are sought in all texts.

Defined results: a null text counts as empty; an empty text has no spans. Repeated rows are scanned each by itself. A column
`spans` of docs is replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import with_made

#: Fixed patterns in the order of kinds. An assigned value needs 6 characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "inferred"]
#: A piece of a run of characters that credentials have, of any length: it begins with a letter or digit, and ends with one, or at the run's end with up to two '=' of padding.
#: Marks at the ends of a run are no part of it, and a run is cut at an '=' before something else.
CANDIDATE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.-]*[A-Za-z0-9])?(?:={1,2}(?=[+/_.-]*\Z))?")
LEAST_CHARS = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")

SAMPLE_DOCS, PER_DOC, PER_KIND = 20_000, 20, 1_000
ALPHA, THRESHOLD = 0.05, 0.25
#: Examples from which a state keeps the one character that follows; the added count of a symbol that a state never saw.
LITERAL_LEAST, UNSEEN = 8, 0.1

_GROUPS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "=", ".", "-"]
_class_of = {c: k for k, group in enumerate(_GROUPS) for c in group}
_spread = [math.log(len(group)) for group in _GROUPS]
_END = -1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind. HEX and ACCESS are runs, so a least length within the pattern finds the same."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credential(text: str, span: tuple[int, int, int]) -> str:
    """The value of a base span: of an assignment, what is assigned."""
    start, kind, end = span
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces of all runs of credential characters, of LEAST_CHARS or more."""
    return [m.span() for run in _RUN.finditer(text) for m in CANDIDATE.finditer(text, *run.span()) if m.end() - m.start() >= LEAST_CHARS]


class Automaton:
    """A probabilistic automaton. state -> counts by symbol (a character, the number of a class, or the end), and successors."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.counts: list[dict] = []
        self.next: list[dict] = []
        self._tree(values)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._keep(self._merge_states())
        self.logs, self.unseen = [], []
        for counts in self.counts:
            total = sum(counts.values()) + UNSEEN * (len(_GROUPS) + 1)
            self.logs.append({k: math.log((n + UNSEEN) / total) - (_spread[k] if isinstance(k, int) and k != _END else 0.0) for k, n in counts.items()})
            self.unseen.append(math.log(UNSEEN / total))

    def _tree(self, values: list[str]) -> None:
        self.counts.append({})
        self.next.append({})
        stack = [(0, 0, values)]
        while stack:
            s, depth, own = stack.pop()
            going = [v for v in own if len(v) > depth]
            if len(going) < len(own):
                self.counts[s][_END] = len(own) - len(going)
            literal = len(own) >= LITERAL_LEAST and len(going) == len(own) and len({v[depth] for v in own}) == 1
            groups: dict = {}
            for v in going:
                groups.setdefault(v[depth] if literal else _class_of[v[depth]], []).append(v)
            for symbol, group in groups.items():
                self.counts[s][symbol] = len(group)
                self.next[s][symbol] = len(self.counts)
                stack.append((len(self.counts), depth + 1, group))
                self.counts.append({})
                self.next.append({})

    def _distance(self, a: int, b: int) -> float | None:
        """The greatest difference of shares of two states, or None if they or their successors differ by the bound."""
        first, stack = None, [(a, b)]
        while stack:
            a, b = stack.pop()
            x, y = self.counts[a], self.counts[b]
            n, m = sum(x.values()), sum(y.values())
            if not n or not m:
                continue
            most = max(abs(x.get(k, 0) / n - y.get(k, 0) / m) for k in {*x, *y})
            first = most if first is None else first
            if most > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)):
                return None
            stack += [(t, self.next[b][k]) for k, t in self.next[a].items() if k in self.next[b]]
        return first or 0.0

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to what is below a; a character of b falls to its class where a has classes only."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a == b:
                continue
            classes = any(isinstance(k, int) for k in self.next[a])
            for k, n in self.counts[b].items():
                own = _class_of[k] if isinstance(k, str) and k not in self.next[a] and classes else k
                self.counts[a][own] = self.counts[a].get(own, 0) + n
                if k != _END:
                    if own in self.next[a]:
                        stack.append((self.next[a][own], self.next[b][k]))
                    else:
                        self.next[a][own] = self.next[b][k]

    def _keep(self, kept: list[int]) -> None:
        """Only these states, numbered anew: the tree's other nodes are folded into them, and would fill the driver's and each worker's memory."""
        number = {s: i for i, s in enumerate(kept)}
        self.counts = [dict(self.counts[s]) for s in kept]
        self.next = [{k: number[t] for k, t in self.next[s].items()} for s in kept]
        self.states = len(kept)

    def _merge_states(self) -> list[int]:
        """The states that are left, the first one being the root."""
        kept = [0]
        while True:
            inside = set(kept)
            edges = [(-self.counts[s][k], s, str(k), k, t) for s in kept for k, t in self.next[s].items() if t not in inside]
            if not edges:
                return kept
            _, s, _, k, t = min(edges)
            near = [(d, r) for r in kept if (d := self._distance(r, t)) is not None]
            if not near:
                kept.append(t)
            else:
                same = min(near)[1]
                self.next[s][k] = same
                self._fold(same, t)

    def log_likelihood(self, value: str) -> float:
        """Of the whole value; after a symbol that a state never saw it stays where it is."""
        s, total = 0, 0.0
        for c in value:
            logs = self.logs[s]
            k = c if c in logs else _class_of[c]
            if k in logs:
                total += logs[k]
                s = self.next[s][k]
            else:
                total += self.unseen[s] - _spread[k]
        return total + self.logs[s].get(_END, self.unseen[s])


def _drawer(seed: int):
    draw = random.Random(seed)
    return draw, lambda chars, k: "".join(draw.choice(chars) for _ in range(k))


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_MIXED = _UPPER + _LOWER + _DIGITS


def published_formats(n: int = 300, seed: int = 7) -> dict[str, list[str]]:
    """Generated examples of published credential formats, labelled by format."""
    draw, some = _drawer(seed)
    return {
        "prefixed": [f"ghp_{some(_MIXED, 36)}" for _ in range(n)],
        "live_key": [f"sk_live_{some(_MIXED, 24)}" for _ in range(n)],
        "map_key": [f"AIza{some(_MIXED + '_-', 35)}" for _ in range(n)],
        "bot": [f"xoxb-{some(_DIGITS, 12)}-{some(_DIGITS, 12)}-{some(_MIXED, 24)}" for _ in range(n)],
        "alphanumeric": [some(_MIXED, draw.randint(20, 48)) for _ in range(n)],
        "base64": [some(_MIXED + "+/", draw.choice([40, 64, 86])) for _ in range(n)],
        "long_base64": [some(_MIXED + "+/", 43) + "=" for _ in range(n)],
        "dotted": [f"eyJ{some(_MIXED, draw.randint(17, 33))}.eyJ{some(_MIXED, draw.randint(20, 60))}.{some(_MIXED + '_-', 43)}" for _ in range(n)],
    }


def ordinary_formats(n: int = 300, seed: int = 11) -> dict[str, list[str]]:
    """Generated tokens that are no credentials, by format: words and names, numbers and dates, versions, UUIDs, digests, paths."""
    draw, some = _drawer(seed)
    hexadecimal = _DIGITS + "abcdef"
    word = lambda a, b: some(_LOWER, draw.randint(a, b))
    words = lambda a, b, least=2, most=5: [word(a, b) for _ in range(draw.randint(least, most))]
    number = lambda a, b=None: some(_DIGITS, draw.randint(a, b or a))
    tail = lambda: draw.choice(["", "", number(1, 4)])
    makers = {
        "word": lambda: draw.choice([word(16, 40), word(16, 40).capitalize(), word(16, 40).upper()]),
        "camel": lambda: draw.choice(["", word(2, 8)]) + "".join(draw.choice([w.capitalize(), w.capitalize(), w.upper()[:4]]) + tail() for w in words(2, 10, 2, 6)),
        "snake": lambda: "_".join(w + tail() for w in words(1, 10, 2, 6)),
        "constant": lambda: "_".join(w.upper() + tail() for w in words(1, 10, 2, 6)),
        "hyphens": lambda: "-".join(draw.choice([w, w.capitalize(), number(1, 4)]) for w in words(1, 12, 2, 7)),
        "dots": lambda: ".".join(draw.choice([w, w.capitalize(), w + tail()]) for w in words(1, 12, 2, 6)),
        "path": lambda: "/".join(draw.choice([w, w.capitalize(), w + tail(), number(1, 4), f"{w}.{word(2, 4)}", f"{w}_{word(2, 8)}", f"{w}-{word(2, 8)}"]) for w in words(1, 12, 2, 7)),
        "number": lambda: number(16, 30),
        "date": lambda: f"{number(4)}-{number(2)}-{number(2)}{draw.choice(['T', '_', '.', '-'])}{number(2, 9)}{draw.choice(['', '.' + number(3, 6), '-' + number(2, 4)])}",
        "version": lambda: draw.choice(["", "v", word(3, 12) + "-", word(3, 12) + "_"]) + ".".join(number(1, 3) for _ in range(draw.randint(2, 4))) + draw.choice(["", "-", "+", "."]) + draw.choice(["rc", "beta.", "alpha", "dev", "post", word(3, 8)]) + number(1, 8),
        "uuid": lambda: "-".join(some(hexadecimal, k) for k in (8, 4, 4, 4, 12)),
        "upper_uuid": lambda: "-".join(some(_DIGITS + "ABCDEF", k) for k in (8, 4, 4, 4, 12)),
        "digest": lambda: draw.choice(["", "", "sha256-", "sha1-", "md5-"]) + some(hexadecimal, draw.choice([16, 20, 32, 40, 64])),
        "upper_digest": lambda: some(_DIGITS + "ABCDEF", draw.choice([16, 20, 32, 40, 64])),
        "marks": lambda: draw.choice("-=_.+/") * draw.randint(16, 40),
    }
    return {name: [make() for _ in range(n)] for name, make in makers.items()}


class Grammar:
    """Automata of credentials by format, and of ordinary formats. Scores are remembered by value, up to a bound."""

    MEMORY = 20_000

    def __init__(self, labelled: dict[str, list[str]]) -> None:
        clean = {k: [v for v in values if v and all(c in _class_of for c in v)] for k, values in labelled.items()}
        self.kinds = {k: Automaton(v) for k, v in clean.items() if v}
        self.ordinary = {k: Automaton(v) for k, v in ordinary_formats().items()}
        self._known: dict[str, float] = {}

    def score(self, value: str) -> float:
        """Of the likeliest credential's format over the likeliest ordinary one, a character."""
        if value not in self._known:
            if len(self._known) >= self.MEMORY:
                self._known.clear()
            least = max(a.log_likelihood(value) for a in self.ordinary.values())
            found = (max((a.log_likelihood(value) for a in self.kinds.values()), default=-math.inf) - least) / len(value)
            if len(value) > 200:
                return found
            self._known[value] = found
        return self._known[value]

    def spans(self, text: str, base: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, score) of candidates that lie within no base span and score above the threshold."""
        found, at, reach = [], 0, 0
        for start, end in candidates(text):
            # Base spans are in order of their starts; of those that begin by here, the one that reaches furthest counts.
            while at < len(base) and base[at][0] <= start:
                reach = max(reach, base[at][2])
                at += 1
            if end > reach and (score := self.score(text[start:end])) > threshold:
                found.append((start, 3, end, score))
        return found


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, per_doc: int = PER_DOC, per_kind: int = PER_KIND) -> Grammar:
    """The grammar from a bounded sample's base matches and from published formats. The driver gets per_kind values of each kind at most, in one job.

    The sample is chosen by a hash of id and text, so rows with one id (or none) are not all in or out.
    """
    n = docs.count()
    step = -(-n // sample_docs) if n else 1
    sample = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(5)), F.lit(step)) == 0)

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(KINDS[s[1]], credential(t, s)) for t in frame["text"] if t for s in base_spans(t)[:per_doc]]
            yield pd.DataFrame(rows, columns=["kind", "value"])

    found = sample.mapInPandas(values, "kind string, value string").distinct()
    first = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    labelled = published_formats()
    for row in found.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= per_kind).orderBy("kind", "_rank").collect():
        labelled.setdefault(row.kind, []).append(row.value)
    return Grammar(labelled)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, grammar: Grammar, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, redact: str | None = None) -> DataFrame:
    """All columns of docs and spans (array of kind, start, end in code points, end exclusive, and score: 1 for base spans), by start, then kind.

    A column `spans` of docs is replaced. With redact, spans of the text are replaced by it and a column n_chars, if there is one, is set anew. One row per
    input row; no shuffle.
    """
    docs = docs.drop("spans")
    counted = redact is not None and dict(docs.dtypes).get("n_chars") in ("bigint", "int")

    def start():
        def make(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            all_spans, texts = [], []
            for t in piece.column(text).to_pylist():
                base = base_spans(t or "")
                spans = sorted([(*s, 1.0) for s in base] + grammar.spans(t or "", base, threshold))
                all_spans.append([{"kind": KINDS[k], "start": a, "end": b, "score": x} for a, k, b, x in spans])
                if redact is not None and spans:
                    parts, at = [], 0
                    for a, _, b, _ in spans:
                        if b > at:
                            parts += [t[at:a], redact] if a >= at else []
                            at = b
                    t = "".join(parts) + t[at:]
                texts.append(t)
            found = {"spans": pa.array(all_spans, _SPANS)}
            if redact is not None:
                found[text] = pa.array(texts, pa.string())
            if counted:
                own = piece.column("n_chars")
                found["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, own.to_pylist(), strict=True)], own.type)
            return found

        return make

    return with_made(docs, text, 4_000_000, start, "spans array<struct<kind: string, start: long, end: long, score: double>>")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of each base kind, the digest of base spans, and all spans as text."""
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "inferred")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )
