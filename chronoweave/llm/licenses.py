"""Licence scan: identifier tags and notice phrases in whole texts.

One Aho-Corasick automaton finds notice phrases and identifier tags in the text's word
sequence, in any letter case. The expression behind a tag is read from the text itself by a
shunting-yard parser that knows and, or, with and parentheses; it stays a tree, so
nested alternatives are never multiplied out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import column_of, map_arrow, texts_of

#: Phrases of the contract and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notice phrases that the method adds. Names as in the public SPDX licence list
#: (spdx.org/licenses), in words without punctuation, and sentences of the notices themselves.
NOTICE_PHRASES = {
    "academic free license": "afl",
    "affero general public license": "agpl",
    "apache license": "apache",
    "apple public source license": "apsl",
    "artistic license": "artistic",
    "blue oak model license": "blueoak",
    "boost software license": "boost",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd zero clause license": "0bsd",
    "business source license": "busl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cecill free software license": "cecill",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons": "creative-commons",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "educational community license": "ecl",
    "eiffel forum license": "efl",
    "elastic license": "elastic",
    "european union public license": "eupl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "ibm public license": "ipl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "licence ouverte": "etalab",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "mulan permissive software license": "mulanpsl",
    "no rights reserved": "none-reserved",
    "open data commons": "odc",
    "open database license": "odbl",
    "open software license": "osl",
    "openssl license": "openssl",
    "permission is hereby granted": "permissive-grant",
    "permission to use copy modify": "permissive-grant",
    "php license": "php",
    "postgresql license": "postgresql",
    "public domain": "public-domain",
    "python software foundation license": "psf",
    "redistribution and use in source": "redistribution-clause",
    "ruby license": "ruby",
    "server side public license": "sspl",
    "sil open font license": "ofl",
    "some rights reserved": "some-reserved",
    "university of illinois ncsa open source license": "ncsa",
    "universal permissive license": "upl",
    "vim license": "vim",
    "without warranty of any kind": "no-warranty",
    "x11 license": "x11",
    "zlib license": "zlib",
    "zope public license": "zpl",
}
#: Identifiers that ask for no more than a notice.
PERMISSIVE = frozenset("0bsd apache-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsl-1.0 cc0-1.0 isc mit mit-0 ncsa postgresql psf-2.0 unlicense upl-1.0 x11 zlib".split())
#: Evidence that a document carries a licence, by kind of finding.
WEIGHTS = {"tag": 0.95, "base": 0.8, "notice": 0.7}
TAG_WORDS = "spdx license identifier"
TAG = re.compile(rb"spdx-license-identifier[ \t]*:", re.IGNORECASE)
TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: ASCII letters lowered, other ASCII but digits made a separator, all else kept.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, n_notices long, permissive boolean, score double"


def tokens_at(data: bytes, at: int = 0):
    """Lower-case tokens of an expression from a place on; they end where something else stands."""
    while found := TOKEN.match(data, at):
        yield found[1].decode().lower()
        at = found.end()


def parse_expression(tokens) -> list[str]:
    """Reverse Polish form of a licence expression, by shunting yard.

    Reads as far as the text stays well formed; raises ValueError if it is not.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in tokens:
        if token in PRECEDENCE:
            if not operand:
                raise ValueError(f"operator {token!r} without a left side")
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                break  # a remark after the expression
            stack.append(token)
        elif token == ")":
            if not operand:
                raise ValueError("')' without a licence before it")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break  # the end of a remark around the tag
            stack.pop()
        else:
            if operand:
                break  # prose after the expression
            out.append(token)
            operand = True
    if not operand:
        raise ValueError("expression ends early")
    while stack:
        if (top := stack.pop()) == "(":
            raise ValueError("'(' without ')'")
        out.append(top)
    return joined_exceptions(out)


def joined_exceptions(rpn: list[str]) -> list[str]:
    """A licence with its exception as one name; an exception belongs to a single licence."""
    out: list[str] = []
    for token in rpn:
        if token != "with":
            out.append(token)
            continue
        if len(out) < 2 or out[-1] in PRECEDENCE or out[-2] in PRECEDENCE:
            raise ValueError("'with' joins one licence and one exception")
        exception = out.pop()
        out[-1] = f"{out[-1]}-with-{exception}"
    return out


def licences(rpn: list[str]) -> set[str]:
    return {t for t in rpn if t not in PRECEDENCE}


def evaluate(rpn: list[str], allowed) -> bool:
    """Whether the expression can be met with allowed licences alone: one pass over the form."""
    stack: list[bool] = []
    for token in rpn:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if token == "or" else left and right)
        else:
            stack.append(token in allowed)
    return stack[0]


def infix(rpn: list[str]) -> str:
    """The expression with parentheses only where or stands inside and."""
    stack: list[tuple[list[str], str]] = []
    for token in rpn:
        if token not in PRECEDENCE:
            stack.append(([token], ""))
            continue
        (right, r), (left, x) = stack.pop(), stack.pop()
        both = [["(", *side, ")"] if token == "and" and kind == "or" else side for side, kind in ((left, x), (right, r))]
        left = both[0]
        left.append(token)
        left.extend(both[1])
        stack.append((left, token))
    return " ".join(stack[0][0]).replace("( ", "(").replace(" )", ")")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("tag", {TAG_WORDS: ""}), ("base", BASE_PHRASES), ("notice", NOTICE_PHRASES)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    found.make_automaton()
    return found


def _expressions(data: bytes, folded: bytes, words: list[int]) -> list[list[str]]:
    """Parsed expressions of the tags that start at these words."""
    letters = np.frombuffer(folded, np.uint8) != 32
    starts = np.flatnonzero(letters & np.concatenate([[True], ~letters[:-1]]))
    out = []
    for at in starts[words].tolist():
        if found := TAG.match(data, at):
            try:
                out.append(parse_expression(tokens_at(data, found.end())))
            except ValueError:
                continue
    return out


def scan_text(text: str) -> tuple:
    """One document's findings, in the order of SCHEMA after doc_id."""
    data = text.encode("utf-8", "surrogatepass")
    folded = data.translate(_FOLD)
    words = folded.split()
    # one space between words, one at either end: a match then covers whole words. A letter for
    # each byte: places in the line are places in the bytes
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found: dict[str, list[int]] = {"base": [], "tag": [], "notice": []}
    labels: dict[str, set[str]] = {"base": set(), "tag": set(), "notice": set()}
    for end, (kind, label, length) in _automaton().iter(line):
        found[kind].append(end - length + 1)
        labels[kind].add(label)
    labels["tag"] = set()
    places = np.empty(0, np.int64)
    expressions: list[list[str]] = []
    if found["base"] or found["tag"]:
        # where each word stands in the line
        at = np.cumsum([1, *map(len, words)])[:-1] + np.arange(len(words))
        places = np.searchsorted(at, found["base"])
        if found["tag"]:
            expressions = _expressions(data, folded, np.searchsorted(at, found["tag"]).tolist())
            labels["tag"] = set().union(*map(licences, expressions))
    miss = 1.0
    for kind, own in labels.items():
        miss *= (1 - WEIGHTS[kind]) ** len(own)
    n = len(places)
    every = ",".join(sorted(labels["base"] | labels["notice"] | labels["tag"]))
    permissive = any(evaluate(e, PERMISSIVE) for e in expressions) if expressions else None
    return len(words), n, int(places.min()) if n else None, int(places.max()) if n else None, ",".join(sorted(labels["base"])), every, list(map(infix, expressions)), len(found["notice"]), permissive, 1.0 - miss


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row of docs, whatever its length.

    Null and empty texts have no words, no labels and score 0. Rows repeat if they
    repeat in docs; a null id stays null; other columns, of any name, are not read.
    A malformed tag expression adds no label. permissive tells whether one of the tags'
    expressions can be met with PERMISSIVE licences alone, null without a tag. Scans row
    by row, in time linear in the text: no shuffle.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan_text(t) for t in texts_of(batch)]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "n_notices", "permissive", "score"]
        return pa.record_batch([column_of(batch, "doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scan, SCHEMA)
