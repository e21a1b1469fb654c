"""Secret scans: base patterns and a linear-chain CRF over tokens.

The CRF tags tokens as O (outside), B (a secret begins) or I (inside). A token's score sums weights of its
shape class, of the classes of the two tokens before and the one after it, and of the file's class; tags also
have transition weights. The best tags are found by Viterbi.

One structural constraint holds in training and decoding: I stands only on a token that touches the one before
it. B may stand on any token. So the tags of a chunk (a run without white space) meet those of its neighbours
only through the transitions at its two ends. Where O on the whole chunk beats every other tagging by the trained
weights, whatever tags stand before and after it, O is part of the best tagging of the whole text; this is worked
out once for each shape of a chunk and its context (``Crf.outside``). Runs of the other chunks are decoded, with
O before and after and their neighbours as context: together that is exactly the best tagging of the whole text.

There are no labels for secrets in the tables, so the CRF is trained on lines from a seeded generator
(``TRAIN_LINES``), by maximum likelihood in numpy.

Defined cases: a null text counts as empty; an empty text has no spans; long texts are read whole, in time that goes
with their length; repeated rows each get their own result; a null doc_id is kept; an empty table gives no rows;
columns of the same names as the result's are left out by the query, and returned as they are by the stage.
"""

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import WordCache, give_back

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Shorter words behind a secret's closing quote are now and then tagged, and nothing tells them from prose.
CRF_LEAST = 8

#: Lines that the generator makes for training.
TRAIN_LINES = 1000

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W\d_]+|[^\s]")
_CHUNK = re.compile(r"\S+")
_KEY = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|private|signature|akia", re.A)
# Token classes.
PLAIN, KEY, ASSIGNMENT, QUOTE, JOINER, PUNCT, SHORT_NUM, NUM, CODE, HEXLIKE, UPPER, MIXED, LONG, EDGE, CASED, RUN = range(16)
N_CLASSES, N_FILES, O, B, I = 16, 4, 0, 1, 2
_NEVER = -1e9
#: O must be better by more than rounding for a chunk to be left out of decoding.
_CLEARLY = 1e-6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns' matches, in the order of the result."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def token_class(t: str) -> int:
    if not t[0].isalnum():
        return ASSIGNMENT if t in "=:" else QUOTE if t in "\"'`" else JOINER if t in "+/.-_" else PUNCT
    if not any(c in "0123456789" for c in t):
        key = len(t) <= 20 and _KEY.search(t.lower())
        if t.isascii() and len(t) >= 8 and sum(x.isupper() != y.isupper() for x, y in zip(t, t[1:])) >= (5 if key else 4):
            return CASED
        return KEY if key else RUN if t.isascii() and len(t) >= 20 else PLAIN
    if t.isdigit():
        return SHORT_NUM if len(t) <= 4 else NUM
    if len(t) < 8:
        return CODE
    if re.fullmatch(r"[0-9a-f]+", t):
        return HEXLIKE
    if len(t) >= 24:
        return LONG
    return UPPER if t.upper() == t else MIXED


def shape(chunk: str) -> tuple[int, ...]:
    """The classes of a chunk's tokens. Within a chunk every token touches the one before it."""
    return tuple(token_class(t) for t in _TOKEN.findall(chunk))


def file_class(text: str, base: list) -> int:
    """2 if the base patterns found something, and 1 more if a colon or equals sign stands on every second line."""
    return 2 * bool(base) + (2 * (text.count("=") + text.count(":")) >= text.count("\n") + 1)


class Crf:
    """Weights: own[tag, class], before[tag, class], before2, after, file[tag, file class], move[tag, tag]."""

    names = ("own", "before", "before2", "after", "file")

    def __init__(self):
        self.w = {n: np.zeros((3, N_FILES if n == "file" else N_CLASSES)) for n in self.names}
        self.move = np.zeros((3, 3))
        self.move[O, I] = _NEVER

    def decode(self, classes: list[int], begin: list[bool], touch: list[bool], left: list[int], right: int, file: int) -> list[int]:
        """Viterbi over one run of tokens, O before and after. left: the classes of the two tokens before it; right: of the next."""
        own, b1, b2, af, fi = (self.rows[n] for n in self.names)
        move = self.moves
        n = len(classes)
        ctx = [*left, *classes, right]
        score, back = [0.0, _NEVER, _NEVER], []
        for i in range(n):
            c, p, pp, nx = ctx[i + 2], ctx[i + 1], ctx[i], ctx[i + 3]
            new, came = [], []
            for s in (O, B, I):
                if s == B and not begin[i] or s == I and not touch[i]:
                    new.append(_NEVER * 2)
                    came.append(O)
                    continue
                best = max((O, B, I), key=lambda r, s=s: score[r] + move[r][s])
                new.append(score[best] + move[best][s] + own[s][c] + b1[s][p] + b2[s][pp] + af[s][nx] + fi[s][file])
                came.append(best)
            score = new
            back.append(came)
        s = max((O, B, I), key=lambda r: score[r] + move[r][O])
        tags = []
        for came in reversed(back):
            tags.append(s)
            s = came[s]
        return tags[::-1]

    def outside(self, key: tuple) -> bool:
        """Whether O beats every other tagging of a chunk, whatever tags stand before and after it.

        key: the classes of the two tokens before it, of its own tokens, and of the next; the class of the file.
        """
        before2, before, classes, right, file = key
        own, b1, b2, af, fi = (self.rows[n] for n in self.names)
        move = self.moves
        ctx = [before2, before, *classes, right]
        gains = [[own[s][ctx[i + 2]] + b1[s][ctx[i + 1]] + b2[s][ctx[i]] + af[s][ctx[i + 3]] + fi[s][file] for s in (O, B, I)] for i in range(len(classes))]
        for entry in (O, B, I):
            # The best taggings up to a token by its tag, if some token isn't O; and the one of O alone.
            some, plain = [_NEVER, _NEVER, _NEVER], None
            for i, e in enumerate(gains):
                new = [max(r + move[k][s] for k, r in enumerate(some)) + e[s] for s in (O, B, I)]
                # Within a chunk I only follows B or I; at its first token nothing touches.
                if plain is None:
                    new, plain = [_NEVER, move[entry][B] + e[B], _NEVER], move[entry][O] + e[O]
                else:
                    new[B] = max(new[B], plain + move[O][B] + e[B])
                    plain += move[O][O] + e[O]
                some = new
            if any(max(r + move[k][after] for k, r in enumerate(some)) > plain + move[O][after] - _CLEARLY for after in (O, B)):
                return False
        return True

    def freeze(self) -> "Crf":
        self.rows, self.moves = {n: w.tolist() for n, w in self.w.items()}, self.move.tolist()
        return self

    def caches(self) -> tuple[WordCache, WordCache]:
        """Shapes by chunk, and ``outside`` by shape and context, kept for a task; they don't travel with the weights."""
        if not hasattr(self, "kept"):
            self.kept = WordCache(shape, 50_000), WordCache(self.outside, 50_000)
        return self.kept

    def forget(self) -> None:
        """At a task's end."""
        for cache in self.__dict__.pop("kept", ()):
            cache.forget()
        give_back()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}


def _line(rng: random.Random) -> tuple[str, tuple[int, int] | None, bool]:
    """A line, the span of its secret if it has one, and whether its file looks like settings."""
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    word = lambda: "".join(rng.choice(("an", "er", "ti", "on", "the", "re", "ou", "ge", "la", "es")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    phrase = []

    def passphrase() -> str:
        """Letters only, told from prose by what stands before them."""
        phrase.append(True)
        return rng.choice(("", "", "", "-", "_", ".")).join(word() + word() for _ in range(rng.randint(2, 5)))

    kind = rng.random()
    head, tail = words(0, 4), words(0, 4)
    letters = alnum[:52]
    if kind < 0.45:
        secret = rng.choice((
            lambda: some("0123456789abcdef", 16, 64), lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 12, 16),
            lambda: some(alnum, 12, 40), lambda: rng.choice(("ghp", "sk", "pat", "xox")) + rng.choice("_-") + some(alnum, 16, 36),
            lambda: some(alnum, 10, 24) + rng.choice("+/-_.") + some(alnum, 8, 24), lambda: some(letters, 12, 40), lambda: rng.choice(("ghp", "sk", "pat", "xox")) + rng.choice("_-") + some(letters, 16, 36),
            lambda: some(alnum + "+/", 20, 60) + rng.choice(("", "=", "==")), lambda: passphrase(), lambda: passphrase()))()
        if phrase or rng.random() < 0.75:
            key = rng.choice(("passphrase", "pwd", "auth", "credentials", "passwort", "access key")) if phrase else rng.choice(("password", "secret", "token", "api_key", "auth", "access key", "client_secret", "private key", "Authorization", "pwd", "credentials"))
            lead = key + rng.choice((" = ", "=", ": ", ":", " := ", ": Bearer ")) + rng.choice(('"', "'", ""))
        else:
            lead = ""
        head = f"{head} {lead}".lstrip()
        if head and not lead:
            head += " "
        at = len(head)
        return head + secret + rng.choice(('"', "'", "", ";", ",")) + " " + tail, (at, at + len(secret)), rng.random() < 0.5
    other = rng.choice((
        lambda: f"+{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(1000000, 9999999)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{word()}{rng.randint(1, 9999)}@{word()}.com", lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}",
        lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 30)}", lambda: f"https://{word()}.org/{word()}/{rng.randint(10, 9999999)}", lambda: f"${rng.randint(1, 99)},{rng.randint(100, 999)}",
        lambda: str(rng.randint(10**6, 10**16)), lambda: f"{word()}{rng.randint(10, 99999)}", lambda: words(2, 5), lambda: f"{word()}: {word()}", lambda: f"{rng.choice(('token', 'key', 'secret'))} {word()}",
        lambda: f"{word()}, {word().capitalize()} {word()}. {word().capitalize()} ({word()}) {word()}-{word()}!", lambda: rng.choice("/-_.").join(word() for _ in range(rng.randint(2, 6))), lambda: f"{word()}{word().capitalize()}{word().capitalize()}", lambda: f"{rng.choice(('www.', 'http://', 'https://'))}{word()}.{rng.choice(('com', 'org'))}/" + "/".join(word() for _ in range(rng.randint(0, 3))) + rng.choice(("", f"?{word()}={word()}")), lambda: f"{word()}: http://{word()}.com/{word()}",
        lambda: f"the {rng.choice(('password', 'key', 'secret', 'token'))} {rng.choice(('is', 'of', 'to', 'for'))} {word()}{rng.choice(' -')}{word()}", lambda: f"{word().upper()} {word()}{word()}{word()}{word()}: {words(1, 3)}", lambda: f"{rng.choice(('Author', 'key', 'License'))}: {word().capitalize()} {word()}",
        lambda: f"{rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}"))()
    return f"{head} {other} {tail}".strip(), None, rng.random() < 0.2


def _encoded(lines: list) -> dict[str, np.ndarray]:
    """Padded arrays of token classes, constraints and tags."""
    rows = []
    for text, span, config in lines:
        toks = list(_TOKEN.finditer(text))
        tags = [O if not span or m.start() < span[0] or m.end() > span[1] else B if m.start() == span[0] else I for m in toks]
        rows.append((toks, tags, 2 * bool(base_spans(text)) + config))
    n, t = len(rows), max(len(r[0]) for r in rows)
    out = {k: np.full((n, t), v) for k, v in (("own", EDGE), ("before", EDGE), ("before2", EDGE), ("after", EDGE), ("file", 0), ("tag", O), ("touch", False), ("real", False))}
    for i, (toks, tags, file) in enumerate(rows):
        c = [EDGE, EDGE, *(token_class(m[0]) for m in toks), EDGE]
        k = len(toks)
        out["own"][i, :k], out["before"][i, :k], out["before2"][i, :k], out["after"][i, :k] = c[2:-1], c[1:-2], c[:-3], c[3:]
        out["file"][i, :k], out["tag"][i, :k], out["real"][i, :k] = file, tags, True
        out["touch"][i, :k] = [j > 0 and toks[j - 1].end() == m.start() for j, m in enumerate(toks)]
    return out


@lru_cache(maxsize=2)
def train(lines: int = TRAIN_LINES, seed: int = 7, steps: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam with a small L2 penalty; forward and backward sums run over all lines at once."""
    rng = random.Random(seed)
    x = _encoded([_line(rng) for _ in range(lines)])
    n, t = x["own"].shape
    crf = Crf()
    allowed = np.stack([np.ones((n, t), bool), np.ones((n, t), bool), x["touch"]], 2)
    gold = np.eye(3)[x["tag"]] * x["real"][..., None]
    pairs = np.einsum("nts,ntr->sr", gold[:, :-1], gold[:, 1:])
    params = [*(crf.w[k] for k in crf.names), crf.move]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda a, axis: (top := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis))
    for step in range(1, steps + 1):
        e = sum(crf.w[k].T[x[k]] for k in crf.names)
        e = np.where(allowed, e, _NEVER)
        e[~x["real"]] = (0, _NEVER, _NEVER)
        f, b = np.empty((t, n, 3)), np.zeros((t, n, 3))
        f[0] = e[:, 0] + np.array([0, 0, _NEVER])
        for i in range(1, t):
            f[i] = lse(f[i - 1][:, :, None] + crf.move, 1) + e[:, i]
        for i in range(t - 2, -1, -1):
            b[i] = lse(crf.move + (e[:, i + 1] + b[i + 1])[:, None, :], 2)
        z = lse(f[-1], 1)
        p = np.exp(f + b - z[:, None]).transpose(1, 0, 2) * x["real"][..., None]
        grad = []
        for k in crf.names:
            g = np.zeros_like(crf.w[k])
            np.add.at(g.T, x[k].ravel(), (gold - p).reshape(-1, 3))
            grad.append(g / n)
        both = np.zeros((3, 3))
        for i in range(1, t):
            both += np.exp(f[i - 1][:, :, None] + crf.move + (e[:, i] + b[i])[:, None, :] - z[:, None, None])[x["real"][:, i]].sum(0)
        grad.append((pairs - both) / n)
        for j, (w, g) in enumerate(zip(params, grad)):
            free = w > _NEVER / 2
            g = np.where(free, g - decay * np.where(free, w, 0), 0)
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            w += rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return crf.freeze()


def crf_spans(text: str, base: list[tuple[int, int, int]], crf: Crf) -> list[tuple[int, int]]:
    """Spans of B I* tokens over the whole text of CRF_LEAST characters or more, without those that overlap a base span."""
    shapes, outside = crf.caches()
    of = list(map(shapes.__getitem__, text.split()))  # the same chunks as those of _CHUNK
    if not of:
        return []
    file, found = file_class(text, base), []
    before2, before, open_chunks = EDGE, EDGE, []
    lefts = {}
    for i, (c, nx) in enumerate(zip(of, [*(x[0] for x in of[1:]), EDGE])):
        key = (before2, before, c, nx, file)
        if not (outside[key] if len(c) <= 32 else crf.outside(key)):
            open_chunks.append(i)
            lefts[i] = [before2, before]
        before2, before = (before, c[0]) if len(c) == 1 else c[-2:]
    if not open_chunks:
        return []
    at = [m.span() for m in _CHUNK.finditer(text)]
    j = 0
    while j < len(open_chunks):
        k = j
        while k + 1 < len(open_chunks) and open_chunks[k + 1] == open_chunks[k] + 1:
            k += 1
        first, last = open_chunks[j], open_chunks[k]
        j = k + 1
        toks = list(_TOKEN.finditer(text, at[first][0], at[last][1]))
        classes = [c for x in of[first : last + 1] for c in x]
        touch = [i > 0 and toks[i - 1].end() == m.start() for i, m in enumerate(toks)]
        tags = crf.decode(classes, [True] * len(toks), touch, lefts[first], of[last + 1][0] if last + 1 < len(of) else EDGE, file)
        i = 0
        while i < len(tags):
            if tags[i] == B:
                e = i + 1
                while e < len(tags) and tags[e] == I:
                    e += 1
                found.append((toks[i].start(), toks[e - 1].end()))
                i = e
            else:
                i += 1
    # Both lists go up in one walk. Spans of different base kinds may overlap, so ends are carried as their maximum.
    out, k, reach = [], 0, -1
    for s, e in found:
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s and e - s >= CRF_LEAST:
            out.append((s, e))
    return out


def scan(text: str | None, crf: Crf) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind) by start, then kind as in KINDS."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + [(s, e, 3) for s, e in crf_spans(text, base, crf)], key=lambda s: (s[0], s[2]))


def redact(text: str | None, crf: Crf, mark: str = "[SECRET]") -> str | None:
    """The text with every secret replaced; of an assignment, only the value goes."""
    if not text:
        return text
    cuts = []
    for s, e, kind in scan(text, crf):
        if kind == 0:
            s = ASSIGN.match(text, s).start(2)
        cuts.append((s, e))
    out, at = [], 0
    for s, e in sorted(cuts):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint"


def _spoken(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(text: Column, crf: Crf) -> Column:
    """A struct (SCHEMA) of each text's spans."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            rows = []
            for t in a:
                spans = scan(t.as_py(), crf)
                kinds = [k for _, _, k in spans]
                base = _spoken(x for x in spans if x[2] < 3)
                rows.append({"n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": _spoken(spans), "n_crf": kinds.count(3)})
            yield pa.array(rows, pa.struct([(n, pa.int64() if n.startswith("n_") else pa.string()) for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")]))
        crf.forget()

    return F.arrow_udf(run, SCHEMA)(text)


def redacted(text: Column, crf: Crf) -> Column:
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            yield pa.array([redact(t.as_py(), crf) for t in a], pa.string())
        crf.forget()

    return F.arrow_udf(run, "string")(text)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", find_secrets(F.col("text"), train()).alias("r")).select("doc_id", "r.*")


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with their secrets replaced and n_chars, if they have it, brought up to date."""
    out = docs.withColumn("text", redacted(docs["text"], train()))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
