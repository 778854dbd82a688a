"""Secret scanning: a wide search for candidates, and a random forest that removes false ones.

A candidate is a run of at least ``SHORTEST`` characters of the alphabet of keys and encoded bytes,
or any value of at least ``SHORTEST_NAMED`` characters assigned to a name that speaks of
credentials, up to white space or the closing quote. Findings that overlap are joined to one.
The forest (trained by Spark's own learner) judges its length, the changes of character class, how usual its
letter pairs are, how much of it a dictionary covers, its digits, capitals and variety,
whether it belongs to a path, and the words and signs beside it.

Training takes labelled findings: (before, candidate, after, label). ``labelled_findings``
makes some where nobody has labelled any, from a bounded sample of the matches in all rows: values of a public key format, and
values with digits assigned to a name that speaks of credentials, are true; runs without a digit
and without such a name, and short plain words assigned to one, are false; the rest is left out.
Each long example counts a second time cut short, so that length alone tells nothing.
Dictionary and letter pairs come from the false ones. Everything else covers all rows and whole texts.

``scan`` returns a row per finding, ``redact`` the documents with their findings replaced.
Null and empty text has no findings. Rows are judged one by one, so repeated rows and null ids
give rows of their own. Without true or false examples there is no forest, and what
``labelled_findings`` would call true counts; a warning says so. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

SHORTEST = 16
SHORTEST_NAMED = 6
SAMPLE_ROWS = 3000  # of each kind of example
SAMPLE_CHARS = 2000
BESIDE = 40  # characters of context on either side
TREES, DEPTH = 25, 7
MASK = "[SECRET]"

# --- fixed values: words that speak of credentials, and a public key format ---
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key",
         "access_key", "credential", "bearer", "auth")
KEY_FORMAT = r"(?:AKIA|ASIA)[0-9A-Z]{16}"
# --- end of fixed values ---

_RUN = r"[A-Za-z0-9+/_\-]"
_CANDIDATE = re.compile(rf"(?<!{_RUN}){_RUN}{{{SHORTEST},}}={{0,2}}")
_ASSIGNED = rf"(?:{'|'.join(NAMES)})[\"']?\s{{0,2}}(?:=>|:=|[=:])\s{{0,2}}"
_VALUE = re.compile(
    rf"{_ASSIGNED}(?:\"([^\s\"]{{{SHORTEST_NAMED},}})|'([^\s']{{{SHORTEST_NAMED},}})|([^\s\"']\S{{{SHORTEST_NAMED - 1},}}))", re.I)
_FORMAT = re.compile(rf"{KEY_FORMAT}\Z")
_NAMED = re.compile(rf"(?:{'|'.join(NAMES)})\W{{0,6}}\Z", re.I)
FEATURES = ("length", "changes", "pairs", "dictionary", "digits", "capitals", "variety", "separators",
            "in_path", "assigned", "quoted", "named")


def candidates(text: str) -> list[tuple[int, int]]:
    spans = {m.span() for m in _CANDIDATE.finditer(text)}
    for m in _VALUE.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:  # without quotes, so signs of the sentence may follow
            b = a + len(text[a:b].rstrip(".,;)]}\"'"))
        if b - a >= SHORTEST_NAMED:
            spans.add((a, b))
    return sorted(spans)


def _beside(text: str, a: int, b: int) -> tuple[str, str, str]:
    return text[max(0, a - BESIDE):a], text[a:b], text[b:b + BESIDE]


def format_label(before: str, candidate: str) -> bool | None:
    """True or false where the form alone tells."""
    digits = any(c.isdigit() for c in candidate)
    named = bool(_NAMED.search(before))
    if _FORMAT.match(candidate) or named and digits:
        return True
    if named and len(candidate) < SHORTEST and candidate.isalpha() and candidate[1:].islower():
        return False
    return None if digits or named else False


class Habits:
    """Letter pairs and three-letter pieces of ordinary words."""

    def __init__(self, words: list[str]) -> None:
        words = [w.lower() for w in words]
        pairs = Counter(w[i:i + 2] for w in words for i in range(len(w) - 1))
        total = sum(pairs.values())
        self.pairs = {p: math.log((n + 0.5) / (total + 500)) for p, n in pairs.items()}
        self.unseen = math.log(0.5 / (total + 500))
        pieces = Counter(w[i:i + 3] for w in words for i in range(len(w) - 2))
        self.pieces = {p for p, n in pieces.items() if n >= 2}

    def features(self, before: str, candidate: str, after: str) -> list[float]:
        n, low = len(candidate), candidate.lower()
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in candidate]
        pairs = [self.pairs.get(low[i:i + 2], self.unseen) for i in range(n - 1)]
        covered = sum(low[i:i + 3] in self.pieces for i in range(n - 2))
        sign = before.rstrip(" \"'")[-1:]
        return [float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1), sum(pairs) / (n - 1),
                covered / (n - 2), kinds.count("d") / n, kinds.count("u") / n, len(set(candidate)) / min(n, 64),
                kinds.count("s") / n, float(before[-1:] in ("/", ".", "\\") or "://" in before or after[:1] == "."),
                float(sign in ("=", ":") and sign != ""), float(before[-1:] in ("'", '"') and before != ""),
                float(bool(_NAMED.search(before)))]


class Forest:
    """Trees as arrays; a score is the share of trees that vote for a secret."""

    def __init__(self, described: str) -> None:
        """From the description Spark gives of a trained forest."""
        self.trees = []
        for part in re.split(r"Tree \d+[^\n]*\n", described)[1:]:
            lines = [line.strip() for line in part.splitlines() if line.strip()]
            nodes: list[list] = []  # feature, threshold, left, right, vote
            self._read(lines, nodes)
            self.trees.append(tuple(map(np.array, zip(*nodes))))

    def _read(self, lines: list[str], nodes: list[list]) -> int:
        line, me = lines.pop(0), len(nodes)
        if line.startswith("Predict"):
            nodes.append([-1, 0.0, 0, 0, float(line.split(":")[1])])
            return me
        found = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        nodes.append([int(found[1]), float(found[2]), 0, 0, 0.0])
        nodes[me][2] = self._read(lines, nodes)
        lines.pop(0)  # Else
        nodes[me][3] = self._read(lines, nodes)
        return me

    def score(self, rows: np.ndarray) -> np.ndarray:
        votes = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, threshold, left, right, vote in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[node]
                node = np.where(f < 0, node, np.where(rows[at_row, np.maximum(f, 0)] <= threshold[node], left[node], right[node]))
            votes += vote[node]
        return votes / max(len(self.trees), 1)


class Detector:
    def __init__(self, habits: Habits, forest: Forest | None) -> None:
        self.habits, self.forest = habits, forest

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """For each text its findings: start, end, score."""
        place, rows, plain = [], [], []
        for k, text in enumerate(texts):
            for a, b in candidates(text) if text else ():
                beside = _beside(text, a, b)
                place.append((k, a, b))
                if self.forest:
                    rows.append(self.habits.features(*beside))
                else:
                    plain.append(float(format_label(*beside[:2]) is True))
        scores = self.forest.score(np.array(rows)) if rows else plain
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        for (k, a, b), s in zip(place, scores):
            if s >= 0.5:
                if out[k] and a < out[k][-1][1]:
                    start, end, high = out[k].pop()
                    a, b, s = start, max(b, end), max(s, high)
                out[k].append((a, b, float(s)))
        return out


def _bounded(pieces: DataFrame, rows: int) -> DataFrame:
    """At most SAMPLE_ROWS different pieces of ``pieces`` (draw, piece), which has ``rows`` rows: the
    lowest of about twice as many drawn, so tasks send the driver few each."""
    if rows > 2 * SAMPLE_ROWS:
        pieces = pieces.where(F.pmod("draw", F.lit(rows)) < 2 * SAMPLE_ROWS)
    return pieces.select("draw", "piece").distinct().orderBy("draw", "piece").limit(SAMPLE_ROWS)


def _pieces(docs: DataFrame) -> list[str]:
    """Pieces of text that hold examples: at most SAMPLE_ROWS around names with a value that has a digit
    and around key formats, as many around names with other values, and as many from anywhere.

    All texts are searched for the first two, so rare secrets are found in tables of any size.
    """
    texts = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("draw"))
    names = "|".join(NAMES)
    searched = lambda run, value: F.regexp_instr("text", F.lit(
        rf"{KEY_FORMAT}|(?i:{names})\W{{1,6}}{run}{_RUN}{{{SHORTEST}}}|"
        rf"(?i:{_ASSIGNED}[\"']?{value}[^\s\"']{{{SHORTEST_NAMED}}})"))
    # Exploded, as the search would otherwise be repeated in the filter.
    spots = texts.select("draw", "text", F.explode(F.array(searched("", ""))).alias("some")).where("some > 0")
    digits = searched(rf"(?={_RUN}{{0,64}}[0-9])", r"(?=[^\s\"']{0,64}[0-9])")
    spots = spots.select("draw", "text", "some", F.explode(F.array(digits)).alias("certain"))
    around = lambda at: F.substring(F.col("text"), F.greatest(F.col(at) - BESIDE, F.lit(1)), F.lit(8 * BESIDE))
    example = lambda certain, piece: F.struct(F.lit(certain).alias("certain"), piece.alias("piece"))
    matches = written(spots.select("draw", F.explode(F.array(
        example(True, F.when(F.col("certain") > 0, around("certain"))),
        example(False, F.when(F.col("certain") != F.col("some"), around("some"))))).alias("m"))
        .select("draw", "m.*").where("piece is not null"), "secret-examples")
    rows = {r[0]: r[1] for r in matches.groupBy("certain").count().collect()}
    place = F.pmod("draw", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)).cast("long")).cast("int") + 1
    anywhere = texts.where("text <> ''").select("draw", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("piece"))
    samples = [_bounded(matches.where(F.col("certain") == kind), n) for kind, n in sorted(rows.items())]
    samples.append(_bounded(anywhere, docs.count()))
    return [row.piece for sample in samples for row in sample.collect()]


def labelled_findings(docs: DataFrame) -> list[tuple[str, str, str, bool]]:
    """(before, candidate, after, label) from at most 3 * SAMPLE_ROWS pieces of text."""
    found = []
    for piece in _pieces(docs):
        # At the ends of a piece a run may be cut.
        spans = [(a, b) for a, b in candidates(piece) if a > 0 and b < len(piece)]
        for a, b in spans:
            beside = _beside(piece, a, b)
            label = format_label(*beside[:2])
            if label is not None:
                found.append((*beside, label))
                before, value, after = beside
                cut = value[:SHORTEST_NAMED + sum(map(ord, value)) % (SHORTEST - SHORTEST_NAMED)]
                if len(value) >= SHORTEST and format_label(before, cut) is label:
                    found.append((before, cut, after, label))
    return found


def train(docs: DataFrame, findings: list[tuple[str, str, str, bool]] | None = None) -> Detector:
    """A detector from labelled findings, or from those that ``docs`` (doc_id, text) yields."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    found = labelled_findings(docs) if findings is None else findings
    habits = Habits([c for _, c, _, label in found if not label])
    if len({label for *_, label in found}) < 2:
        warnings.warn("examples of one kind only: the plain rule decides, without a forest", stacklevel=2)
        return Detector(habits, None)
    # Kinds are weighed alike, as false findings are far more frequent.
    share = Counter(label for *_, label in found)
    rows = [(float(label), Vectors.dense(habits.features(b, c, a)), 1.0 / share[label] * len(found))
            for b, c, a, label in found]
    data = docs.sparkSession.createDataFrame(rows, ["label", "features", "weight"])
    learner = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7, weightCol="weight", featureSubsetStrategy="sqrt")
    return Detector(habits, Forest(learner.fit(data).toDebugString))


def scan(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, start, length (in characters), score, secret_sha256 of each finding in ``docs``."""

    def found(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [(i, a, b - a, s, hashlib.sha256(t[a:b].encode()).hexdigest())
                    for i, t, spans in zip(ids, texts, detector.find(texts)) for a, b, s in spans]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "start", "length", "score", "secret_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(found, "doc_id bigint, start bigint, length bigint, score double, secret_sha256 string")


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by MASK; other columns stay as they are."""
    place = docs.columns.index("text")

    def masked(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(place).to_pylist()
            for k, spans in enumerate(detector.find(texts)):
                for a, b, _ in reversed(spans):
                    texts[k] = texts[k][:a] + MASK + texts[k][b:]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(masked, docs.schema)
