"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more key characters that has a digit, mixed case or a provider's format, a value of 6 characters or more that a
name such as password or api_key is set to, or a private key block from its first line to its last.  Candidates that
overlap are one, the widest.  The forest looks at its length, character transitions, dictionary coverage, the path
(source) and the neighbouring words, and is trained from a table of labelled findings (text, start, end, path, label).
``labelled_table`` makes such a table from key formats, for corpora that have none of their own.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.runtime import text_or_empty, trimmed

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
#: A name that secrets are set to, and its value, of 6 characters or more: up to the closing quote, or else up to a blank, a
#: quote or a list's next item.  No length ends it.  Every alternative is a plain run of characters, so a text takes linear time.
NAME = re.compile(r"""(?i:passw(?:or)?d|pwd|secret|token|api_?key|access_?key|auth|credentials?)\w{0,20}["']?\s?[:=]{1,2}>?\s?""")
VALUE = re.compile(r""""((?:[^"\\\n]|\\.){6,})"|'((?:[^'\\\n]|\\.){6,})'|["']?((?:[^\s"'`,;]|[,;](?!\s|$|[\w.\-]{1,40}[=:])){6,})""")
#: What opens a call or an index, which ends a bare value; closing marks after one.
CALL, CLOSING = re.compile(r"[A-Za-z_][\w.]*(?=[(\[])"), ",;)]}>"
#: A private key's block: its first line, what may stand in it, its last line; lines of it where the last one is missing.
BEGIN, END = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
BODY, OPEN_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,]|-(?!----BEGIN|----END))*"), re.compile(r"(?:\s*[A-Za-z0-9+/=]{16,}(?=\s|$))+")
#: Labelled findings to learn from, at most; trees; their depth; findings that a leaf holds at least.
SAMPLE_FINDINGS, TREES, DEPTH, LEAF = 20000, 40, 10, 4
#: Characters of context on either side of a candidate.
CONTEXT = 60
LEAST_SCORE = 0.5

#: Words that speak for a secret, or against one, when they stand next to a candidate or in its path.
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "bearer", "credential", "credentials", "private", "access")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "example", "sample", "test", "dummy", "placeholder", "version", "http", "https", "www", "file", "path", "integrity", "revision", "etag")
PATHS_AGAINST = ("test", "tests", "example", "examples", "docs", "doc", "fixtures", "mock", "vendor")
#: The dictionary for coverage (words of four letters and more that names and paths are made of); a parameter.
DICTIONARY = tuple(
    """
    access account address admin alert application author base block body button cache category change channel check child class
    client cloud code column command comment component config connection contact container content context control create current custom data
    database date default delete description design development device directory display document domain download editor element email empty enable
    error event export feature field file filter first folder format function global group handler header hello help home
    host image import index info input interface item language left length level library line link list load local
    location login main manager master match member memory menu message method model module name network node none note
    number object option order output package page panel parameter parent path pattern platform point position process product profile
    project property public query random read record reference release remote report request resource response result return right root
    route sample screen search section select send server service session setting shared show size source start state status
    step store string style system table target task team template text theme thread time title type unit update
    upload user value version video view volume word work world write year your zone
    """.split()
)
#: How keys of some providers begin.
PROVIDER = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{20}|sk-[A-Za-z0-9]{20}|xox[abprs]-[A-Za-z0-9]")
_WORD = re.compile(r"[A-Za-z]+|[0-9]+")
_NAMED = re.compile(r"""(?i:passw(?:or)?d|pwd|secret|token|api_?key|access_?key|auth|credentials?)\w{0,20}["']?\s?[:=]{1,2}>?\s?["']?$""")
_HINT = re.compile(r"(?i)passw|pwd|secret|token|key|auth|credential")
_FOUND = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
FEATURES = ("length", "log_length", "entropy", "digits", "upper", "lower", "symbols", "class_changes", "hex", "distinct", "longest_run", "vowel_rate", "transition_score", "coverage", "words_for", "words_against", "assigned", "quoted", "path_against", "only_letters", "uuid_like", "key_block", "named", "spaces", "provider", "called")

#: Commonness of character pairs in English text, for the transition score (the most common ones).
PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """Numbers that describe a candidate, in the order of FEATURES."""
    n = len(value)
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    kinds = [kind(c) for c in value]
    run = longest = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    low = value.lower()
    letters = [c for c in low if c.isalpha()]
    left, right = _WORD.findall(before.lower())[-4:], _WORD.findall(after.lower())[:2]
    near = [*left, *right]
    covered = sum(len(x) for x in _FOUND.findall(low))
    return [
        n, math.log(n), -sum(v / n * math.log2(v / n) for v in counts.values()), kinds.count(2) / n, kinds.count(1) / n, kinds.count(0) / n, kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), float(all(c in "0123456789abcdef" for c in low)), len(counts) / min(n, 64), longest,
        sum(c in "aeiou" for c in letters) / max(1, len(letters)), sum(low[i : i + 2] in PAIRS for i in range(n - 1)) / max(1, n - 1), covered / n,
        sum(w in FOR for w in left), sum(w in AGAINST for w in near), float(bool(re.search(r"[:=]\s*[\"'`]?$", before))), float(before[-1:] in "\"'`" and before != ""),
        float(any(w in PATHS_AGAINST for w in _WORD.findall(path.lower()))), float(value.isalpha()), float(bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", low))),
        float(value.startswith("-----BEGIN")), float(bool(_NAMED.search(before))), value.count(" ") / n,
        float(bool(PROVIDER.match(value))), float(after[:1] in "([" and after != ""),
    ]


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """The values that names of secrets are set to."""
    done = 0
    for name in NAME.finditer(text):
        if name.end() < done or not (m := VALUE.match(text, name.end())):  # a name inside a value is part of it
            continue
        done = m.end()
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:  # bare
            if call := CALL.match(text, a, b):
                b = call.end()
            while b > a and text[b - 1] in CLOSING and not ("{" in text[a:b] and text[b - 1] == "}") and not (text[a] == "<" and text[b - 1] == ">"):
                b -= 1
        if b - a >= 6:
            yield a, b


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private key blocks from their first line to their last, however long; of one without a last line, the lines of key text."""
    at = 0
    while m := BEGIN.search(text, at):
        at = BODY.match(text, m.end()).end()
        if end := END.match(text, at):
            at = end.end()
            yield m.start(), at
        elif body := OPEN_BODY.match(text, m.end()):
            yield m.start(), body.end()


def candidates(text: str) -> list[tuple[int, int]]:
    """[start, end) of each candidate in code points, in order; of those that overlap the one that begins first and ends last."""
    found = []
    for m in CANDIDATE.finditer(text):
        value = m.group()
        if any(c.isdigit() for c in value) or not (value.islower() or value.isupper()) or PROVIDER.match(value):  # other words are none
            found.append((m.start(), m.end()))
    if _HINT.search(text):
        found += assigned(text)
        if "PRIVATE KEY-----" in text:
            found += key_blocks(text)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def labelled_findings(n: int = 4000, seed: int = 11, dictionary: tuple[str, ...] = DICTIONARY) -> list[tuple[str, int, int, str, int]]:
    """Generated labelled findings (text, start, end, path, label): key formats in assignments, and what looks like keys."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, lower, upper, digit = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = lower + upper + digit
    word = lambda: rng.choice(dictionary)
    pairs = sorted(PAIRS)
    syllables = lambda: "".join(rng.choice(pairs) for _ in range(rng.randint(6, 12)))
    plain = lambda: "".join(rng.choice(pairs) for _ in range(rng.randint(2, 4)))
    names = ("token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "db_password", "PASSWORD", "credentials", "SECRET_TOKEN", "passwd")
    out = []
    for _ in range(n):
        lead, name = " ".join(syllables() for _ in range(rng.randint(0, 4))), rng.choice(names)
        opens = rng.choice((f'{name} = "', f"{name}: ", f"{name}='", f"{name}=", f'"{name}": "', f"{name}:"))
        kind, call = rng.random(), ""
        if kind < 0.3:  # keys by their formats
            value = rng.choice([lambda: pick(hexa, rng.choice((32, 40, 40, 64))), lambda: pick(every, rng.randint(20, 64)), lambda: "AKIA" + pick(upper + digit, 16), lambda: "AKIA" + pick(upper + "234567", 16), lambda: "AKIA" + pick(upper + "27", 16), lambda: "ghp_" + pick(every, 36), lambda: "sk-" + pick(every, rng.randint(32, 48)), lambda: "xoxb-" + pick(digit, 11) + "-" + pick(every, 24), lambda: pick(every + "+/", rng.randint(30, 86)) + "==", lambda: pick(every + rng.choice(("", "+/", "-_", "!#%&*+,-./:;<=>?@^_|~()[]{}")), int(2 ** rng.uniform(6, 13)))])()
            bare = rng.choice(("key ", "using ", "aws = ", 'id = "', "")) if PROVIDER.match(value) else opens
            before, secret = rng.choice((opens, opens, bare, bare, "private_key " + opens, "Authorization: Bearer ", f"{name} ")), 1
            path = rng.choice(("src/app.py", "config/settings.yml", "src0", ".env", "deploy/values.yaml", ""))
        elif kind < 0.5:  # passwords that people make: words with digits or marks, phrases of words, short random ones
            value = rng.choice([lambda: plain() + pick(digit, rng.randint(1, 4)) + rng.choice("!@#$%&*?"), lambda: plain().capitalize() + rng.choice("!@#$_-.") + pick(digit, rng.randint(2, 4)), lambda: pick(every + "!@#$%^&*", rng.randint(8, 15)), lambda: plain() + pick(digit, 1) + plain() + rng.choice(("", "!", "#")), lambda: "".join(plain() for _ in range(4)), lambda: "".join(word() for _ in range(rng.randint(3, 4)))])()
            before, secret, path = opens, 1, rng.choice(("src/app.py", "config/settings.yml", "src1", ".env", ""))
        elif kind < 0.56:
            value = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(every + "+/", rng.choice((14, 40, 64, 64))) for _ in range(rng.randint(1, 12))) + "\n-----END RSA PRIVATE KEY-----"
            before, secret, path = rng.choice(("", "key: |\n", 'PRIVATE_KEY = """')), 1, rng.choice(("id_rsa", "src2", "deploy/values.yaml"))
        elif kind < 0.7:  # names that are set to something else
            value = rng.choice([lambda: rng.choice(("required", "string", "optional", "invalid", "changeme", "redacted", "missing", "undefined", "password", "unknown")), lambda: ".".join(word() for _ in range(rng.randint(2, 3))), lambda: f"{word()}_{word()}", lambda: f"{word()} {word()} {word()}", lambda: f"${{{word().upper()}_{word().upper()}}}", lambda: f"your_{word()}_here", lambda: "*" * rng.randint(6, 12), lambda: f"<{word()}-{word()}>", lambda: f"/etc/{word()}/{word()}", lambda: f"{word()}[{word()}]", lambda: "the " + " ".join(plain() for _ in range(4)), lambda: " ".join(syllables() for _ in range(int(2 ** rng.uniform(3, 9)))), lambda: rng.choice("x*-.0") * int(2 ** rng.uniform(4, 12)), lambda: word(), lambda: f"{word()}_{word()}(", lambda: f"{word()}.{word()}_{word()}(", lambda: f"{word()}{word().title()}["])()
            value, call = value.rstrip("(["), value[-1:] if value[-1] in "([" else ""
            before, secret, path = (f"{name} = " if call else opens), 0, rng.choice(("src/app.py", "README.md", "docs/guide.md", "tests/test_app.py", "src3"))
        else:
            value, name = rng.choice([
                lambda: (pick(hexa, 40), rng.choice(("commit", "revision", "merge commit"))), lambda: (pick(hexa, rng.choice((32, 64))), rng.choice(("sha256", "md5", "checksum", "integrity sha256", "digest", "etag"))),
                lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(("uuid", "guid", "id", "request"))), lambda: ("/".join(word() for _ in range(rng.randint(3, 6))) + "/" + pick(digit, 3), rng.choice(("path", "file", "see", "https"))),
                lambda: ("_".join(word() for _ in range(rng.randint(3, 5))).title() + pick(digit, 1), rng.choice(("function", "class", "def", "name"))), lambda: (pick(digit, rng.randint(16, 20)), rng.choice(("number", "card", "phone", "order", "the"))),
                lambda: (rng.choice(("xxxxxxxxxxxxxxxx1", "your-token-here-1234", "EXAMPLE_KEY_1234567890", "changeme-changeme-1", "AAAAAAAAAAAAAAAAAAAA1", "AKIA" + pick(upper + digit, 9) + "EXAMPLE")), rng.choice(("token", "key", "password"))),
                lambda: (syllables().capitalize() + syllables()[:4].upper() + pick(digit, 1), rng.choice(("the", "and", "of", "in"))), lambda: (syllables().capitalize() + rng.choice(("-", "_", "/")) + syllables(), rng.choice(("the", "la", "der", "que"))),
                lambda: (pick(digit, 4) + "-" + pick(digit, 2) + "-" + pick(digit, 2) + "T" + pick(digit, 6), rng.choice(("date", "at", "version"))),
            ])()
            before, secret = rng.choice((f"{name} ", f"{name}: ", f"{name} = ", f'{name}="')), 0
            path = rng.choice(("src/app.py", "README.md", "docs/guide.md", "tests/test_app.py", "src3", "examples/demo.js"))
        text = f"{lead} {before}"
        after = before[-1] if before[-1:] in "\"'" and before else rng.choice(("", " ", ",", "\n"))
        out.append((f"{text}{value}{call or after} {syllables()}", len(text), len(text) + len(value), path, secret))
    return out


def labelled_table(spark: SparkSession, n: int = 4000, seed: int = 11) -> DataFrame:
    """``labelled_findings`` as the table that ``learn`` takes; sent as Arrow, so that executors start no Python workers for it."""
    columns = zip(*labelled_findings(n, seed)) if n else [()] * 5
    kinds = {"text": pa.string(), "start": pa.int64(), "end": pa.int64(), "path": pa.string(), "label": pa.int32()}
    return spark.createDataFrame(pa.table({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), columns)}))


class Forest:
    """Trees as flat arrays: feature (-1: leaf), threshold, left, right, value."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = np.flatnonzero(inner)
                node = at[go]
                at[go] = np.where(x[go, feature[node]] <= threshold[node], left[node], right[node])
            out += value[at]
        return out / max(1, len(self.trees))


def train(findings: list[tuple[str, int, int, str, int]], trees: int = TREES, seed: int = 5) -> Forest:
    """Bootstrap samples, sqrt(features) tried at a split, Gini impurity."""
    x = np.array([features(t[a:b], t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT], p or "") for t, a, b, p, _ in findings]).reshape(-1, len(FEATURES))
    y = np.array([f[4] for f in findings], float)
    rng = np.random.default_rng(seed)
    return Forest([_grow(x[i], y[i], rng) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))] if len(y) else [])


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        best = None
        if depth < DEPTH and len(rows) >= 2 * LEAF and 0 < y[rows].mean() < 1:
            for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n, total = np.arange(1, len(order)), ones[-1]
                ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(order) - n >= LEAF)
                if not ok.any():
                    continue
                p, q = ones[:-1] / n, (total - ones[:-1]) / (len(order) - n)
                gini = np.where(ok, n * p * (1 - p) + (len(order) - n) * q * (1 - q), np.inf)
                k = int(gini.argmin())
                if best is None or gini[k] < best[0]:
                    best = (gini[k], f, (v[k] + v[k + 1]) / 2)
        if best:
            _, f, cut = best
            go = x[rows, f] <= cut
            nodes[at][:4] = [f, cut, grow(rows[go], depth + 1), grow(rows[~go], depth + 1)]
        return at

    grow(np.arange(len(y)), 0)
    f, t, left, right, v = (np.array(c) for c in zip(*nodes))
    return f.astype(np.int64), t, left.astype(np.int64), right.astype(np.int64), v


def learn(findings: DataFrame, sample_findings: int = SAMPLE_FINDINGS) -> Forest:
    """From a table (text, start, end, path, label), at most ``sample_findings`` of it by hash; rows without text or label go;
    repeated findings count each time; without any, every score is 0.  Runs its job when it is called."""
    own = findings.select("text", "start", "end", "path", F.col("label").cast("int").alias("label")).where(F.col("text").isNotNull() & F.col("label").isNotNull())
    return train([tuple(r) for r in own.orderBy(F.xxhash64("text", "start", "end"), "text", "start", "end", "path", "label").limit(sample_findings).collect()])


def judge(text: str, path: str, forest: Forest) -> list[tuple[int, int, float]]:
    """(start, end, score) of every candidate of a text."""
    found = candidates(text)
    if not found:
        return []
    x = np.array([features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path) for a, b in found])
    return [(a, b, float(s)) for (a, b), s in zip(found, forest.score(x))]


def scan(docs: DataFrame, forest: Forest, path_col: str = "source", least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, start, end, score, secret_sha256): one row per secret; offsets in code points, end exclusive.

    Null and empty texts have none; a null path counts as empty; repeated rows report each for itself; an empty table
    gives no rows; other columns take no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(sent.value)
        for batch in batches:
            rows = []
            for i in range(0, len(batch), 256):
                for doc_id, text, path in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in ("doc_id", "text", "path"))):
                    rows += [(doc_id, a, b, s, hashlib.sha256(text[a:b].encode()).hexdigest()) for a, b, s in judge(text, path, forest) if s >= least_score]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()))], ["doc_id", "start", "end", "score", "secret_sha256"])

    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), path.alias("path"))
    return rows.mapInArrow(trimmed(run), "doc_id long, start long, end long, score double, secret_sha256 string")


def redact(docs: DataFrame, forest: Forest, path_col: str = "source", least_score: float = LEAST_SCORE, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with each secret of ``text`` replaced by ``mask``.

    All rows and columns stay, whatever their names; null and empty texts stay as they are; a null path counts as empty;
    repeated rows are masked alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest.trees)
    at, by = docs.columns.index("text"), docs.columns.index(path_col) if path_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(sent.value)
        for batch in batches:
            texts = []
            paths = batch.column(by).cast(pa.string()).to_pylist() if by is not None else [""] * len(batch)
            for text, path in zip(batch.column(at).to_pylist(), paths):
                for a, b, s in reversed(judge(text, path or "", forest) if text else []):
                    text = text[:a] + mask + text[b:] if s >= least_score else text
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(trimmed(run), docs.schema)
