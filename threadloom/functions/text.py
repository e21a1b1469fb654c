"""Text functions as Column expressions: tokens, stopwords, HTML, URLs, escapes."""

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stopwords that the analyzer drops by default.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just "
    "don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

SIMPLE_TOKEN = r"[\p{L}\p{N}_]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def simple_tokens(text: Column) -> Column:
    """array<string>: lower-cased runs of letters, digits and underscores."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(SIMPLE_TOKEN), F.lit(0)), F.array().cast("array<string>"))


#: The published Treebank rules, in their order.
TREEBANK_RULES = [
    (r'^"', "`` "), (r'([ (\[{<])"', "$1 `` "), (r"\.\.\.", " ... "), (r"([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1 "), (r"([;@#$%&?!])", " $1 "),
    (r'([^\.])(\.)([\])}>"\']*)\s*$', "$1 $2$3 "), (r"([^\.\s])\.(\s+\p{Lu})", "$1 . $2"), (r"([\]\[(){}<>])", " $1 "), (r"--", " -- "), (r'"', " '' "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "), (r"(?i)\b(can)(not)\b", " $1 $2 "), (r"(?i)\b(gon|wan)(na)\b", " $1 $2 "), (r"(?i)\b(got)(ta)\b", " $1 $2 "),
]


def treebank_tokens(text: Column) -> Column:
    """array<string>: tokens by the published Treebank rules, lower-cased and cleaned.

    Tokens that are substrings of the ASCII punctuation are dropped, ``n't`` becomes ``not``, a hyphen at either end
    and all apostrophes go; an emptied token keeps its place. Sentences aren't told apart: a period splits off where
    it ends the text or stands before a blank and a capital.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.concat(F.lit(""), t, F.lit(" "))
    for pattern, to in TREEBANK_RULES:
        t = F.regexp_replace(t, pattern, to)
    words = F.filter(F.split(F.lower(F.trim(t)), r"\s+"), lambda w: (w != "") & ~F.contains(F.lit(PUNCTUATION), w))
    return F.transform(words, lambda w: F.regexp_replace(F.when(w == "n't", F.lit("not")).otherwise(w), "^-|-$|'", ""))


def positioned(tokens: Column, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """array<struct<term, pos>>: positions are those before stopwords are dropped."""
    placed = F.transform(tokens, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    return F.filter(placed, lambda x: ~x["term"].isin(*stopwords)) if stopwords else placed


def without_comments(placed: Column) -> Column:
    """The usual last step of an analyzer: terms that begin with // go."""
    return F.filter(placed, lambda x: ~x["term"].startswith("//"))


def mapped(words: Column, function: Callable[[str], str], held: int = 500_000) -> Column:
    """array<string>: each word by a Python function, which is called once for each distinct word of a batch and kept for a task."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for a in arrays:
            flat = a.flatten().dictionary_encode()
            if len(known) > held:
                known.clear()
            values = []
            for w in flat.dictionary.to_pylist():
                if (v := known.get(w)) is None:
                    v = known[w] = function(w)
                values.append(v)
            out = pa.array(values, pa.string()).take(flat.indices)
            ends = np.cumsum([0, *(n or 0 for n in a.value_lengths().to_pylist())])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out)

    return F.arrow_udf(run, "array<string>")(words)


def with_terms(placed: Column, terms: Column) -> Column:
    """placed with other terms at the same positions."""
    return F.zip_with(placed, terms, lambda x, t: F.struct(t.alias("term"), x["pos"].alias("pos")))


def by_term(ordered: Column, starts: Column) -> Column:
    """array<struct<term, positions>>. ordered: array<struct<term, pos>> sorted; starts: where its terms begin (``term_starts``). Both should be columns of their own."""
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(ordered))
    run = lambda at, k: F.slice(ordered, at + 1, end(k) - at)
    return F.transform(starts, lambda at, k: F.struct(F.get(ordered, at)["term"].alias("term"), F.transform(run(at, k), lambda x: x["pos"]).alias("positions")))


def term_starts(ordered: Column) -> Column:
    """array<int>: indices of a sorted array<struct<term, pos>> where another term begins."""
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(ordered, i)["term"] != F.get(ordered, i - 1)["term"]))


#: What counts as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def html_strip(html: Column) -> Column:
    """Text of HTML: scripts and styles up to their exact end tags and comments go, tags and &nbsp; become blanks, double blanks are halved twice."""
    t = F.trim(html, F.lit(WHITE))
    t = F.regexp_replace(t, r"(?is)<(script|style).*?>.*?</\1>", "")  # fixed patterns: they define the result
    t = F.regexp_replace(t, r"(?s)<!--.*?-->[\n]?", "")
    t = F.regexp_replace(t, r"(?s)<.*?>", " ")
    t = F.replace(t, F.lit("&nbsp;"), F.lit(" "))
    for _ in range(2):
        t = F.replace(t, F.lit("  "), F.lit(" "))
    return t


def url_basename(url: Column) -> Column:
    """The last segment of a URL's path, without query or fragment."""
    return F.regexp_extract(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r"[^/]*$", 0)


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def unescape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def int_or(text: Column, default: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), default)


def contains_sequence(items: Column, part: Column) -> Column:
    """Whether an array holds another as consecutive items; an empty one always. Items are compared as one joined string, so each array is made once."""
    line = lambda a: F.concat(F.lit("\x01"), F.array_join(a, "\x01"), F.lit("\x01"))
    return (F.size(part) == 0) | F.contains(line(items), line(part))


def sorted_json(value: object) -> str:
    """JSON with sorted keys, other letters than ASCII as they are."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def row_json(columns: list[str]) -> Column:
    """Columns as one JSON object, keys sorted; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
