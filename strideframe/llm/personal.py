"""Personal data: base patterns, and candidates judged by boosted trees.

Base spans are the matches of fixed patterns that pass their checks; they are always reported.  The method
adds spans in other spellings: generators with high recall propose overlapping candidates (digit groups
with any separators, spelled-out or bracketed at-signs and dots, e-mail-like text), gradient-boosted trees
score them by features of their format and of the context, and those that reach a calibrated threshold,
best first and not overlapping what is chosen already, are reported too.

The trees (Spark ML) are fitted on all distinct texts: the base spans there, and the same spans respelled,
are positive; candidates that a rule proves harmless, and base spans broken so that their checks fail, are
negative.  Other candidates may be what the method is for, so they are no examples.  A fifth of the texts is
held out and gives the threshold: the lowest score above which ``precision`` of their examples are positive.
Without examples of both classes, or without such a score, there are base spans only.  Examples, not texts,
are shuffled; copies of a text are told by 128 bits of hash.  The fitted model is a few kilobytes and goes
to the tasks; every whole text is scanned, in one pass without a shuffle.  A caller may bound the texts of
the fit by ``sample``; the first ones by the order of their hashes are taken then.

Null texts are empty.  Offsets are code points, ends exclusive.  Each row gets its own result row.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.store import stage, texts

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
BATCH = 4096  # examples of an Arrow batch
PART = 100_000  # examples that a task of the fit holds

Span = tuple[int, int, str]

# fixed values: the base patterns.  A local part's characters never include the at-sign, so an e-mail is found
# from its at-sign; the look-behind only spares vain attempts within a run of digits.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)]
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if _octets(m[0])]
    out += [(*m.span(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# Generators of candidates.
_GROUPS = re.compile(r"(?<![\w+])[+(]?[0-9](?:[\x20().\-/ ‐-―]{0,3}[0-9]){6,}")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\x20]?[\[({]?\.[\])}]?[\x20]?[0-9]{1,3}){3}(?![0-9])")
_AT = re.compile(r"[\x20]?[\[({<][\x20]?(?:at|@)[\x20]?[\])}>][\x20]?|[\x20]@[\x20]?|@", re.I)
_MAY_HOLD = r"(?i)[0-9@]|[\[({<]\x20?at"  # in Spark: without this a text has neither base spans nor candidates
_BEFORE = re.compile(r"[\w.%+-]{1,64}\Z")
_BEHIND = re.compile(r"[\w-]{1,63}(?:(?:\.|[\x20]?[\[({<][\x20]?(?:dot|\.)[\x20]?[\])}>][\x20]?)[\w-]{1,63}){0,4}", re.I)


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    out = []
    for m in _GROUPS.finditer(text):
        n = len(_digits(m[0]))
        if 13 <= n <= 19:
            out.append((*m.span(), "card"))
        if 7 <= n <= 15:
            out.append((*m.span(), "phone"))
    if "." in text:
        out += [(*m.span(), "ip") for m in _QUAD.finditer(text)]
    for m in _AT.finditer(text):
        before = _BEFORE.search(text, max(0, m.start() - 64), m.start())
        behind = _BEHIND.match(text, m.end())
        if before and behind:
            out.append((before.start(), behind.end(), "email"))
    return out


_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|adresse|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|node", re.I),
    "card": re.compile(r"card|visa|master|credit|karte|carte|tarjeta|pay", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobil|handy|llam|appel|whatsapp", re.I),
}
_OTHER = re.compile(r"isbn|version|order|invoice|price|total|serial|token|sha|md5|date|year|[$€£#=]\s?$", re.I)


_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
                   r"|(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2})(?![0-9])")
_NAMED = re.compile(r"\b(?:isbn(?:-1[03])?|version|release|v)[\x20:.=]{0,3}\Z", re.I)


def harmless(text: str, span: Span) -> bool:
    """Whether a rule proves that a candidate is no personal data of its kind."""
    a, b, kind = span
    inner = text[a:b]
    if kind == "email":
        at = _AT.search(inner)
        return not re.search(r"\.|\bdot\b", inner[at.end():] if at else inner, re.I)  # a domain has a dot
    if _NAMED.search(text, max(0, a - 16), a):
        return True
    if kind == "ip":
        return not all(int(p) <= 255 for p in re.findall(r"[0-9]+", inner))
    if kind == "card":
        return not luhn(_digits(inner))
    return bool(_DATE.match(inner))


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    a, b, kind = span
    inner, digits = text[a:b], _digits(text[a:b])
    left, right = text[max(0, a - 30):a], text[b:b + 15]
    groups = [len(g) for g in re.findall(r"[0-9]+", inner)] or [0]
    tail = re.split(r"[.\])}>]", inner)[-1]
    parts = re.findall(r"[0-9]+", inner)
    return [
        *(float(kind == k) for k in KINDS), float(b - a), float(len(digits)), float(len(groups)),
        float(max(groups)), float(min(groups)), float(groups[0]), float(groups[-1]),
        *(float(inner.count(c)) for c in " -./()[@"), float(inner.startswith("+")),
        float(bool(digits) and 13 <= len(digits) <= 19 and luhn(digits)),
        float(len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)),
        float(len(set(digits))), sum(c.isalpha() for c in inner) / max(1, b - a),
        float(len(tail)), float(tail.isalpha()), float(bool(re.search(r"[\[({<]\s?(?:at|@)", inner, re.I))),
        float(bool(re.search(r"\.|\bdot\b", inner[inner.rfind("@") + 1:] if "@" in inner else inner, re.I))),
        float(left[-1:].isspace() or not left), float(left[-1:].isalnum()), float(left[-1:] in ".,:;/-_=#$"),
        float(right[:1].isspace() or not right), float(right[:1].isalnum()), float(right[:1] in "%/-_="),
        float(len(_digits(left)) + len(_digits(right))),
        float(bool(_CONTEXT[kind].search(left))), float(bool(_OTHER.search(left))),
    ]


def _respelled(kind: str, inner: str) -> Iterator[str]:
    digits = _digits(inner)
    if kind == "email":
        local, domain = inner.split("@", 1)
        yield f"{local} (at) {domain}"
        yield f"{local}[at]{domain.replace('.', '[dot]')}"
        yield f"{local} @ {domain}"
    elif kind == "ip":
        yield inner.replace(".", "[.]")
    elif kind == "card":
        yield ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
        yield "/".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    else:
        national = digits[-10:]
        yield f"({national[:3]}) {national[3:6]}-{national[6:]}"
        yield f"00{digits[:-10]} {national[:3]} {national[3:6]} {national[6:]}"


def _broken(kind: str, inner: str) -> Iterator[str]:
    digits = _digits(inner)
    if kind == "email":
        local, domain = inner.split("@", 1)
        yield f"{local}@{domain.split('.')[0]}"
        yield f"{domain.split('.')[0]} @ {local.replace('.', '')}"
    elif kind == "ip":
        yield ".".join(str(int(p[-3:]) + 300) for p in inner.split("."))
        yield ".".join([*(p[-1] for p in inner.split("."))])
    elif kind == "card":
        yield digits[:-1] + str((int(digits[-1]) + 5) % 10)
        yield digits[:8]
        yield f"978-{digits[0]}-{digits[1:3]}-{digits[3:9]}-{digits[9]}"
    else:
        yield digits[-8:]
        yield digits[-10:]
        yield f"20{digits[-6:-4]}-{digits[-4:-2]}-{digits[-2:]}"
        yield f"20{digits[-6:-4]}-0{digits[-4]}-1{digits[-2]} 1{digits[-1]}:{digits[-3]}0"


def examples(text: str) -> Iterator[tuple[list[float], float]]:
    """Features and labels of a text's base spans and harmless candidates, and of its base spans respelled
    and broken in place."""
    base = base_spans(text)
    exact = set(base)
    starts = [a for a, _, _ in base]
    ends = [0, *accumulate((b for _, b, _ in base), max)]  # the furthest end of the first k spans
    for span in candidates(text):
        if span in exact:
            yield features(text, span), 1.0
        elif ends[bisect_left(starts, span[1])] <= span[0] and harmless(text, span):  # overlaps no base span
            yield features(text, span), 0.0
    for a, b, kind in base:
        for make, label in ((_respelled, 1.0), (_broken, 0.0)):
            for inner in make(kind, text[a:b]):
                yield features(text[max(0, a - 40):a] + inner + text[b:b + 40],
                               (min(a, 40), min(a, 40) + len(inner), kind)), label


class Trees:
    """A fitted ensemble as arrays: feature (-1: leaf), threshold, left child, right child, value."""

    def __init__(self, model, threshold: float):
        self.threshold, self.trees = threshold, []
        for tree, weight in zip(model.trees, model.treeWeights):
            nodes: list[list[float]] = []

            def add(node) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, at, at, node.prediction() * weight])
                if node.getClass().getSimpleName() == "InternalNode":
                    split = node.split()
                    nodes[at][:2] = [split.featureIndex(), split.threshold()]
                    nodes[at][2], nodes[at][3] = add(node.leftChild()), add(node.rightChild())
                return at

            add(tree._java_obj.rootNode())
            self.trees.append(np.array(nodes))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probabilities that the model gives."""
        margin = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := nodes[at, 0] >= 0).any():
                f = np.maximum(nodes[at, 0].astype(np.int64), 0)
                left = x[np.arange(len(x)), f] <= nodes[at, 1]
                at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]), at).astype(np.int64)
            margin += nodes[at, 4]
        return 1 / (1 + np.exp(-2 * margin))


_EXAMPLE = pa.schema({"key": pa.binary(), "i": pa.int64(), "x": pa.list_(pa.float64()), "label": pa.float64(), "held": pa.bool_()})


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example with its text's hash and its place there, BATCH at a time however many a text has."""
    def of(text: str, h: int) -> Iterator[tuple]:
        key = blake2b(text.encode(), digest_size=16).digest()
        for i, (x, label) in enumerate(examples(text)):
            yield key, i, x, label, h % 5 == 0

    for batch in batches:
        found = (e for t, h in zip(batch.column("text"), batch.column("h")) for e in of(t.as_py(), h.as_py()))
        while some := list(islice(found, BATCH)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), _EXAMPLE.types)], schema=_EXAMPLE)


def labelled(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """The examples of the distinct texts of (doc_id, text): spot (for an order that doesn't hang on partitions), x, label, held."""
    some = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").rlike(_MAY_HOLD))
    if sample is not None:
        # the smallest hashes first, then their texts: of a group of copies a task passes on one
        first = some.select("h").distinct().orderBy("h").limit(sample)
        some = some.join(F.broadcast(first), "h", "left_semi").distinct().orderBy("h", "text").limit(sample)
    # held out by text: spans and their respellings stand on one side
    found = some.select("text", F.xxhash64("h").alias("h")).mapInArrow(
        _examples, "key binary, i long, x array<double>, label double, held boolean")
    # copies of a text give equal rows
    return found.distinct().select(F.xxhash64("key", "i").alias("spot"), "x", "label", "held")


def _threshold(judged: DataFrame, precision: float) -> float | None:
    """The lowest score p above one half such that ``precision`` of the rows (p, label) from it on are positive; equal scores
    stand or fall together."""
    scores = judged.where("p > 0.5").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right"))
    scores = stage(scores.repartitionByRange("p").withColumn("part", F.spark_partition_id()), "pii-scores")
    # rows and positives of the parts above, one row a part
    n = right = 0
    above = []
    for r in scores.groupBy("part").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).orderBy(F.desc("part")).collect():
        above.append((r["part"], n, right))
        n, right = n + r["n"], right + int(r["right"])
    if not above:
        return None
    before = scores.sparkSession.createDataFrame(above, "part int, n_above long, right_above long")
    from_here = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    share = (F.sum("right").over(from_here) + F.col("right_above")) / (F.sum("n").over(from_here) + F.col("n_above"))
    enough = scores.join(F.broadcast(before), "part").select("p", share.alias("share")).where(F.col("share") >= precision)
    return enough.agg(F.min("p")).first()[0]


def fit(docs: DataFrame, sample: int | None = None, precision: float = PRECISION) -> Trees | None:
    """The trees fitted on the distinct texts of (doc_id, text), or on ``sample`` of them, and their threshold."""
    rows = stage(labelled(docs, sample), "pii-examples")
    counts = {(r["held"], r["label"]): r["count"] for r in rows.groupBy("held", "label").count().collect()}
    if len(counts) < 4:
        return None
    # parts and their order hang on the examples alone, not on how the input is cut
    parts = -(-(counts[False, 0.0] + counts[False, 1.0]) // PART)
    fitted = rows.where("not held").repartition(parts, "spot").sortWithinPartitions("spot", "x", "label")
    features_of = array_to_vector("x").alias("features")
    model = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=1).fit(fitted.select(features_of, "label"))
    judged = model.transform(rows.where("held").select(features_of, "label"))
    threshold = _threshold(judged.select(vector_to_array("probability")[1].alias("p"), "label"), precision)
    return None if threshold is None else Trees(model, threshold)


def _chosen(base: list[Span], found: list[Span], scores: np.ndarray, threshold: float) -> list[Span]:
    chosen = list(base)
    for score, span in sorted(zip(scores.tolist(), found), key=lambda x: (-x[0], x[1])):
        if score >= threshold and not any(a < span[1] and span[0] < b for a, b, _ in chosen):
            chosen.append(span)
    return sorted(chosen, key=lambda s: (s[0], KINDS.index(s[2])))


def _scan(trees: Trees | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            # a candidate that overlaps a base span can't be added
            taken = sorted((a, b) for a, b, _ in base)
            found, scores = [], np.zeros(0)
            if trees:
                starts = np.array([a for a, _ in taken])
                for span in candidates(text):
                    k = int(np.searchsorted(starts, span[1]))
                    if not any(a < span[1] and span[0] < b for a, b in taken[max(0, k - len(KINDS)):k]):
                        found.append(span)
                if found:
                    scores = trees.scores(np.array([features(text, s) for s in found]))
            spans = _chosen(base, [s for s, p in zip(found, scores) if p >= trees.threshold], scores[scores >= trees.threshold], trees.threshold) if found else base
            out.append((*(sum(s[2] == k for s in base) for k in KINDS), written(base), written(spans)))
        columns = list(zip(*out)) if out else [()] * 6
        yield pa.record_batch({"doc_id": batch.column("doc_id"),
                               **{f"n_{k}": pa.array(columns[i], pa.int64()) for i, k in enumerate(KINDS)},
                               "base": pa.array(columns[4], pa.string()), "spans": pa.array(columns[5], pa.string())})


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None,
                  precision: float = PRECISION) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, comma-joined)."""
    docs = texts(docs, id_col, text_col)
    trees = fit(docs, sample, precision)
    return docs.mapInArrow(partial(_scan, trees), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
