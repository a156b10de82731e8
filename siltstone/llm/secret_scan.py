"""Secret scans with a random forest that removes false positives.

Candidates are long runs of token characters with a digit or of unusual length, values given to names such as
``token`` or ``password``, blocks of private keys, and the password in an address such as ``db://user:password@host``. The forest looks at a candidate's length, transitions between character classes, coverage by
dictionary words, whether it lies in a path, and the words around it.

No table of labelled findings is given, so the forest is trained on findings made here from templates: ``FINDINGS`` of
them, each true or false by construction, from a fixed seed. Own labelled findings take their place as an argument.
"""

from __future__ import annotations

import base64
import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, slices, spread

FINDINGS, TREES, DEPTH, CUT = 6000, 40, 12, 0.5
NAMES = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth_token", "client_secret", "private_key", "credential", "bearer", "authorization"]
HARMLESS = ["commit", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "etag", "integrity", "revision", "uuid", "guid", "request_id", "trace_id", "build", "image", "png", "example", "sample", "placeholder", "dummy", "test_vector", "card", "phone", "order"]
WORDS = ["about", "account", "action", "address", "admin", "after", "also", "array", "back", "base", "before", "build", "cache", "call", "change", "check", "class", "client", "code", "common", "config", "content", "context", "control", "core", "count", "create", "data", "date", "default", "delete", "demo", "description", "dev", "document", "element", "error", "event", "example", "file", "filter", "find", "first", "font", "form", "format", "from", "function", "get", "group", "handler", "header", "here", "home", "http", "image", "index", "info", "input", "insert", "item", "java", "key", "language", "last", "length", "library", "line", "link", "list", "local", "main", "manager", "message", "method", "model", "module", "name", "network", "node", "number", "object", "option", "order", "org", "output", "page", "parameter", "parent", "path", "place", "process", "product", "profile", "project", "property", "public", "query", "read", "record", "request", "resource", "response", "result", "return", "role", "sample", "script", "search", "select", "server", "service", "session", "set", "setting", "size", "source", "start", "state", "status", "store", "string", "style", "system", "table", "target", "template", "test", "text", "time", "title", "token", "type", "update", "user", "util", "value", "version", "view", "window", "with", "word", "work", "write", "your"]

_RUN = rb"[A-Za-z0-9+/_.\-]{16,}={0,2}"
_NAMED = rb"(?i:\b(?:" + b"|".join(n.replace("_", "[_-]?").encode() for n in NAMES) + rb"))[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>|,;()]{8,})"
_BLOCK = rb"(-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]{0,20000}?-----END [A-Z0-9 ]{0,24}PRIVATE KEY-----)"
_IN_ADDRESS = rb"://[^\s/:@\"'<>]{0,64}:([^\s/@\"'<>]{4,})@"
_CANDIDATE = re.compile(_BLOCK + rb"|" + _IN_ADDRESS + rb"|" + _NAMED + rb"|(" + _RUN + rb")")
_MARKS = b".!?*#$%&-"  # may end a sentence rather than a value
_DICTIONARY = re.compile("|".join(sorted(WORDS, key=len, reverse=True)).encode())
_BEFORE = re.compile(b"|".join(n.replace("_", "[_-]?").encode() for n in NAMES))
_HARMLESS = re.compile(b"|".join(n.replace("_", "[_-]?").encode() for n in HARMLESS))
_CLASS = bytes(1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 0 for c in range(256))
AROUND = 48  # bytes before and after that count as neighbouring words


def candidates(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, end with the marks behind it) of candidates, in order, none overlapping."""
    out = []
    for m in _CANDIDATE.finditer(text):
        kind = m.lastindex
        a, whole = m.span(kind)
        if kind < 3:  # a block, or in an address: as it is
            out.append((a, whole, whole))
            continue
        value = text[a:whole].rstrip(_MARKS)
        if kind == 3 or len(value) >= 24 or (len(value) >= 16 and any(48 <= c <= 57 for c in value)):
            if len(value) >= 8:
                out.append((a, a + len(value), whole))
    return out


def features(text: bytes, a: int, b: int) -> list[float]:
    v = text[a:b]
    n = len(v)
    before, after = text[max(0, a - AROUND) : a].lower(), text[b : b + AROUND].lower()
    kinds = v.translate(_CLASS)
    moves = Counter(zip(kinds, kinds[1:], strict=False))
    share = [kinds.count(k) / n for k in range(4)]
    counts = Counter(v)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    low = v.lower()
    covered = sum(len(m) for m in _DICTIONARY.findall(low))
    hexed = sum(c in b"0123456789abcdef-" for c in low) / n
    last = before[-12:]
    return [
        n,
        moves[1, 3] / n, moves[3, 1] / n, moves[1, 2] / n, moves[2, 1] / n, (moves[2, 3] + moves[3, 2]) / n, (moves[1, 1] + moves[2, 2] + moves[3, 3]) / n,
        *share,
        entropy, len(counts) / n, hexed, covered / n, max(counts.values()) / n,
        sum(c in b"aeiou" for c in low) / n,
        v.count(b"/"), v.count(b"."), float(before[-1:] in (b"/", b"\\", b".")), float(b"://" in before[-24:] + v),
        float(last[-1:] in (b'"', b"'")), float(b"=" in last[-4:]), float(b":" in last[-4:]),
        float(bool(_BEFORE.search(before[-28:]))), float(bool(_BEFORE.search(before))),
        float(len(_HARMLESS.findall(before[-28:]))), float(bool(_HARMLESS.search(after))), float(bool(_HARMLESS.search(low))),
        float(v.count(b"-") == 4 and n == 36),
        float(v.startswith(b"-----BEGIN")), float(text[b : b + 1] == b"@"), float(n == 20 and v[:1] == b"A" and v.isupper() and v.isalnum()),
    ]


def made_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[bytes, int, int, bool]]:
    """(text, start, end, is a secret) from templates."""
    r = random.Random(seed)
    text = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexed = lambda k: text(k, "0123456789abcdef")
    b64 = lambda k: base64.b64encode(bytes(r.randrange(256) for _ in range(k))).decode()
    prose = lambda: " ".join(text(r.randint(2, 9), low) for _ in range(r.randint(0, 7)))
    # kinds of values: hexadecimal, base 62, base 64, mixed passwords, prefixed keys
    true = [lambda: hexed(r.choice((32, 40, 40, 48, 64))), lambda: text(r.randint(18, 48), low + up + dig), lambda: b64(r.randint(15, 48)), lambda: text(r.randint(10, 20), low + up + dig + "!@#%_"), lambda: f"{text(r.randint(2, 4), low)}_{text(r.randint(24, 40), low + up + dig)}", lambda: f"A{text(3, up)}{text(16, up + dig)}", lambda: f"{text(4, up)}{text(16, up + dig)}"]
    words = lambda k, sep: sep.join(r.choice(WORDS) for _ in range(k))
    out = []
    while len(out) < n:
        secret = r.random() < 0.5
        case = r.choice((str, str, str.upper))
        if r.random() < 0.12:  # without a name: key blocks, addresses with a password, keys by their form; addresses without
            kind = r.randrange(4)
            mark = r.choice(("", "RSA ", "EC ", "OPENSSH "))
            body = "\n".join(b64(r.randint(4, 48)) for _ in range(r.randint(1, 20)))
            lead, v, tail = (
                ("", f"-----BEGIN {mark}PRIVATE KEY-----\n{body}\n-----END {mark}PRIVATE KEY-----", "\n"),
                (f"{r.choice(('postgres', 'mysql', 'amqp', 'https', 'redis'))}://{text(r.randint(3, 9), low)}:", text(r.randint(5, 20), low + up + dig + "!#%_"), f"@{text(6, low)}.{r.choice(('com', 'org', 'local'))}/{text(4, low)}"),
                (" ", f"A{text(3, up)}{text(16, up + dig)}", " "),
                ("https://", f"{'/'.join(r.choice(WORDS) for _ in range(4))}/{text(8, dig)}", " "),
            )[kind]
            head = f"{prose()} {lead}".encode()
            out.append((head + v.encode() + f"{tail}{prose()}".encode(), len(head), len(head) + len(v), kind < 3))
            continue
        if secret:
            v = r.choice(true)()
            name = r.choice(NAMES)
            quote = r.choice(('"', '"', "'", ""))
            lead = case(name) + r.choice((" = ", "=", ": ", '": ', " := ", " ")) + quote
            v = v.upper() if r.random() < 0.1 else v
        else:
            kind, quote = r.randrange(9), r.choice(('"', "", ""))
            lead = r.choice(HARMLESS) + r.choice((" ", ": ", " = ", "=")) + quote
            if kind == 0:
                v = hexed(r.choice((32, 40, 64)))
            elif kind == 1:
                v, lead = str(uuid.UUID(int=r.getrandbits(128))), r.choice(("id=", "request_id: ", "uuid ", "/"))
            elif kind == 2:
                v, lead = words(r.randint(3, 6), "/") + "/" + text(4, dig), r.choice(("/", "./", "https://", "~/"))
            elif kind == 3:
                v, lead = words(r.randint(3, 5), r.choice(("_", "-", ".", ""))) + r.choice(("", "2", "10")), r.choice(("", " ", "(", "call "))
            elif kind == 4:
                lead = r.choice(NAMES) + r.choice((" = ", ": ", "=")) + quote
                v = r.choice((text(1, "xX*0-") * r.randint(10, 30), "your_" + words(2, "_") + "_here", words(3, "_"), "example-" + words(2, "-"), "changeme" + text(2, dig), "{{" + words(2, ".") + "}}"))
            elif kind == 5:
                v, lead = text(r.randint(16, 19), dig), r.choice(("", " ", "card ", "order "))
            elif kind == 6:
                v, lead = b64(r.randint(40, 150)), r.choice(("image/png;base64,", "integrity=sha384-", "data:"))
            elif kind == 7:
                v, lead = "".join(text(r.randint(1, 2), "aeiou") + text(r.randint(1, 3), low) for _ in range(9)), " "
            else:
                v, lead = hexed(40), r.choice(("commit ", "sha1 ", "revision ", "checksum: ", "tree "))
        head = f"{prose()} {lead}".encode()
        tail = f"{quote} {prose()}".encode()
        if secret or len(v) >= 8:
            out.append((head + v.encode() + tail, len(head), len(head) + len(v), secret))
    return out


class RandomForest:
    """Trees on bootstrap samples, each split the best of a few random features by Gini impurity; flat arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 3):
        self.n, self.depth, self.seed, self.trees = trees, depth, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        tries = max(1, int(np.sqrt(x.shape[1])))
        for _ in range(self.n):
            tree = ([], [], [], [], [])
            rows = rng.integers(0, len(x), len(x))
            self._grow(x[rows], y[rows].astype(np.float64), 0, tree, rng, tries)
            self.trees.append(tuple(map(np.array, tree)))
        return self

    def _grow(self, x, y, depth, tree, rng, tries) -> int:
        feature, value, left, right, share = tree
        at = len(feature)
        for a, v in zip(tree, (-1, 0.0, 0, 0, float(y.mean()) if len(y) else 0.0), strict=True):
            a.append(v)
        if depth >= self.depth or len(y) < 4 or y.min() == y.max():
            return at
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if len(cut):
                p, q = c[cut - 1] / cut, (c[-1] - c[cut - 1]) / (len(y) - cut)
                cost = cut * p * (1 - p) + (len(y) - cut) * q * (1 - q)
                i = int(cost.argmin())
                if best is None or cost[i] < best[0]:
                    best = (cost[i], int(f), (v[cut[i] - 1] + v[cut[i]]) / 2)
        if best is None:
            return at
        below = x[:, best[1]] <= best[2]
        if below.all() or not below.any():
            return at
        feature[at], value[at] = best[1], best[2]
        left[at] = self._grow(x[below], y[below], depth + 1, tree, rng, tries)
        right[at] = self._grow(x[~below], y[~below], depth + 1, tree, rng, tries)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, value, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inside = np.flatnonzero(feature[node] >= 0)
                if not len(inside):
                    break
                n = node[inside]
                node[inside] = np.where(x[inside, feature[n]] <= value[n], left[n], right[n])
            total += share[node]
        return total / max(1, len(self.trees))


def train(findings: list[tuple[bytes, int, int, bool]] | None = None) -> RandomForest:
    findings = made_findings() if findings is None else findings
    return RandomForest().fit(np.array([features(*f[:3]) for f in findings]), np.array([f[3] for f in findings]))


MASK = b"[SECRET]"


def find_secrets(forest: RandomForest, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each text the number of candidates and the spans judged secret."""
    spans = [candidates(t) if t else [] for t in texts]
    rows = [features(t, a, b) for t, s in zip(texts, spans, strict=True) for a, b, _ in s]
    hit = iter((forest.score(np.array(rows)) > CUT).tolist() if rows else [])
    return [(len(s), [(a, end) for a, _, end in s if next(hit)]) for s in spans]


def masked(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], MASK]
        at = b
    return b"".join([*out, text[at:]])


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=1):
            texts = part.column(1).to_pylist()
            found = find_secrets(model.value, texts)
            clean = [None if t is None else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([sha256(t or b"").hexdigest() for t in clean]), pa.array(clean, pa.binary())],
                ["doc_id", "n_candidates", "n_secrets", "masked_sha256", "masked"],
            )

    return run


def scan(spark: SparkSession, docs: DataFrame, forest: RandomForest | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_candidates, n_secrets, masked_sha256, masked; a row for each row.

    Null text: no candidates, null stays null (its hash is that of nothing). Null and equal doc_ids go through. A secret
    is masked with the marks behind it, up to the next space or quote. Extra columns are ignored; an empty table gives
    an empty result.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    model = spark.sparkContext.broadcast(forest or train())
    rows = docs.mapInArrow(_scan(model), "doc_id long, n_candidates long, n_secrets long, masked_sha256 string, masked binary")
    return rows.withColumn("masked", F.col("masked").cast("string"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, docs_of(spark, sf_dir)).drop("masked")
