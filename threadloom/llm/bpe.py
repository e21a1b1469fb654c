"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for every base symbol and takes one gadget for each
merge (u, v), in order of rank: the arcs labelled u are led to a copy of their target that has no arc v, and beside
them an arc labelled uv is led to where v led from there. What is left accepts exactly the tokenizations that
applying the merges makes, so a word has one accepting path, and its labels are the encoding.

All arcs of one label lead to one state: that holds at the start and each gadget keeps it. So a state is known by
the label that leads to it, and the gadgets are stored as tables: ``born`` (rank of the gadget that made a label's
arcs), ``left`` and ``right`` (its merge), ``cutoff`` (rank at which the arc v went from u's state). ``step`` looks
a transition up in them; each worker keeps the transitions that it has looked up.

Text is split, lower-cased and normalised as the tokenizer file says. Texts that are composed of characters below U+0530 take
a plain path; others use the library's own normaliser and splitter, as these have the same Unicode tables.

Defined cases: a null text counts as empty; empty texts have no tokens (digests of nothing); the special tokens'
strings in a text become their ids, as in the library's default; repeated rows each get their own result.
"""

import gc
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import WordCache, give_back

TOKENIZER = "word_bpe_49k.json"
SUFFIX = "</w>"
_LATER = 1 << 60

#: Letters and numbers below U+0530, as the splitter's \p{L} and \p{N}, for lower-cased text.
_LETTERS = "".join(chr(c) for c in range(0x530) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x530) if unicodedata.category(chr(c))[0] == "N")
_SPACES = "\t-\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(_LETTERS)}]+|[{re.escape(_NUMBERS)}]|[^{_SPACES}{re.escape(_LETTERS + _NUMBERS)}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_FAR = re.compile("[^\x00-ԯ]")


def byte_symbols() -> list[str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


class Automaton:
    """The compiled merges of a byte-level BPE whose words end in SUFFIX."""

    def __init__(self, vocab: dict[str, int], merges: list, specials: dict[str, int] = {}):
        self.label = {i: t for t, i in vocab.items()} | {i: t for t, i in specials.items()}
        self.specials = specials
        self.born, self.left, self.right, self.cutoff = {}, {}, {}, {}
        made = {}
        for u, v in merges:
            made[vocab[u + v]] = (u, v)
        for t, i in vocab.items():
            if i not in made:
                self.born[i] = -1
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.inner = {t: i for t, i in vocab.items() if i in self.born and not t.endswith(SUFFIX)}
        self.final = {t.removesuffix(SUFFIX): i for t, i in vocab.items() if i in self.born and t.endswith(SUFFIX)}
        self.reach: dict[str, int] = {}  # four symbols -> length of the longest label that begins so; other labels have three at most
        for t in (*self.inner, *self.final):
            if len(t) > 3:
                self.reach[t[:4]] = max(self.reach.get(t[:4], 4), len(t))
        self.symbols = byte_symbols()
        self.known: dict[int, bool] = {}

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        """Applies merge (u, v); one that no text can reach leaves the automaton as it is."""
        if u not in self.born or v not in self.born or uv in self.born or not self._has(u, v, rank - 1):
            return
        self.cutoff[u, v] = rank
        self.born[uv], self.left[uv], self.right[uv] = rank, u, v

    def _has(self, u: int, t: int, now: int) -> bool:
        """Whether the state that u leads to had an arc t once the gadgets up to ``now`` were applied."""
        while True:
            at = self.born[t]
            if at > now:
                return False
            while True:
                gone = self.cutoff.get((u, t))
                if gone is not None and at < gone <= now:
                    return False
                if self.born[u] <= at:
                    break
                now, u = self.born[u] - 1, self.right[u]  # before u's arcs were made, this state was where its right part led
            if at < 0:
                return True
            t, now = self.left[t], at  # t's arcs were put beside those of its left part

    def step(self, u: int, t: int) -> bool:
        """Whether token t may follow token u."""
        key = u << 20 | t
        if (ok := self.known.get(key)) is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            ok = self.known[key] = self._has(u, t, _LATER)
        return ok

    def encode_symbols(self, s: str) -> list[int]:
        """The labels of the one accepting path that spells s, by depth-first search, longest labels first."""
        n, path, dead = len(s), [], set()
        inner, final, reach, known = self.inner.get, self.final.get, self.reach.get, self.known.get
        at, prev, size = 0, -1, min(reach(s[:4], 3), n)
        while at < n:
            while size:
                t = final(s[at:]) if at + size == n else inner(s[at : at + size])
                if t is not None and (not dead or (at + size, t) not in dead):
                    if prev < 0 or known(prev << 20 | t) or self.step(prev, t):
                        break
                size -= 1
            if size:
                path.append((at, t, size))
                at, prev = at + size, t
                size = min(reach(s[at : at + 4], 3), n - at)
            else:
                if not path:
                    raise ValueError(f"no path spells {s[:50]!r}")
                start, t, size = path.pop()
                dead.add((at, t))
                at, size, prev = start, size - 1, path[-1][1] if path else -1
        return [t for _, t, _ in path]

    def encode_word(self, word: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        s = word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self.symbols.__getitem__, word.encode()))
        ids = self.encode_symbols(s)
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: list[int]) -> str:
        """Labels of the ids, joined by blanks, as the library does for a file without a decoder."""
        return " ".join(map(self.label.__getitem__, ids))


class Encoder:
    """Texts -> ids with one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.specials = path, {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.automaton = Automaton({t: i for t, i in spec["model"]["vocab"].items() if t not in self.specials}, [tuple(m) for m in spec["model"]["merges"]], self.specials)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.chunks, self.words = WordCache(self._chunk), WordCache(self.automaton.encode_word)
        self.far = WordCache(lambda s: np.array(self.automaton.encode_symbols(s), "<u4").tobytes())
        self.library = None

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space; normalising and splitting never look across one."""
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        plain = plain.lower()
        if plain.isascii() or not _FAR.search(plain):
            return b"".join(map(self.words.__getitem__, _SPLIT.findall(plain)))
        return self._library(chunk)

    def _library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        t = self.library
        return b"".join(map(self.far.__getitem__, (w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text)))))

    def _plain(self, text: str) -> bytes:
        if _SEPARATORS.search(text):  # white space to Python, not to the splitter
            return self._library(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(np.array([self.specials[p]], "<u4").tobytes() if p in self.specials else self._plain(p) for p in self.cut.split(text))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """At a task's end. An automaton is built in a third of a second, and its worker may have other work next."""
    encoder.cache_clear()
    gc.collect()
    give_back()


SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encoded(text: Column, path: str | None = None) -> Column:
    """array<int> of ids. path: the tokenizer file on the executors; None finds the installed one there."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path or tokenizer_path())
        for a in arrays:
            ids = [e.encode(t.as_py()) for t in a]
            ends, flat = np.cumsum([0, *(len(x) // 4 for x in ids)]), b"".join(ids)
            del ids
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "<i4")))
            del flat
        del e
        forget()

    return F.arrow_udf(run, "array<int>")(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text that the ids stand for."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path or tokenizer_path())
        for a in arrays:
            yield pa.array([None if x.as_py() is None else e.automaton.decode(x.as_py()) for x in a], pa.string())

    return F.arrow_udf(run, "string")(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """A struct (SCHEMA): the ids are encoded, decoded again, and only counts and digests leave the worker."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path or tokenizer_path())
        for a in arrays:
            n, ids_sha, text_sha = [], [], []
            for t in a:
                ids = e.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(e.automaton.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
        del e
        forget()

    return F.arrow_udf(run, SCHEMA)(text)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as it goes to training: documents with their ids and count, in place of columns of these names (ids, n_tokens)."""
    own = [f"`{c}`" for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    return docs.select(*own, encoded(docs["text"]).alias("ids")).withColumn("n_tokens", F.size("ids").cast("bigint"))
