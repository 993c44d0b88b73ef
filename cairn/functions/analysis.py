"""Text analysis: tokenizers and token filters, for queries on the driver and for columns.

The common analyzers (standard, white space or n-grams, lower case) run as JVM expressions; n-grams of
classed characters, folding and stemming run in Arrow batches of few rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cairn.errors import invalid, unsupported
from cairn.functions import stemming

MAX_TOKEN_LENGTH, MAX_NGRAM_RANGE = 1 << 20, 1
#: Rows per Arrow batch, as a text can hold megabytes, and texts whose tokens are made at once.
ARROW_ROWS, PIECE = 128, 16
# Characters that folding spells out, stemmer languages, and n-gram character classes.
FOLDED = {
    "Æ": "AE", "æ": "ae", "Ð": "D", "Đ": "D", "ð": "d", "đ": "d", "Ø": "O", "ø": "o", "Þ": "TH", "þ": "th", "ß": "ss", "ẞ": "SS", "Ħ": "H", "ħ": "h", "ı": "i",
    "Ĳ": "IJ", "ĳ": "ij", "Ł": "L", "ł": "l", "Ŋ": "N", "ŋ": "n", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t",
}
LANGUAGES = ("arabic", "danish", "dutch", "english", "finnish", "french", "german", "greek", "hungarian", "italian", "norwegian", "portuguese", "romanian", "russian", "spanish", "swedish", "tamil", "turkish")
CLASSES = {"letter": r"\p{L}", "digit": r"\p{Nd}", "whitespace": r"\t-\r\x1c-\x1f\p{Zl}\p{Zp}\x20  -  -  　", "punctuation": r"\p{P}", "symbol": r"\p{S}"}
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def fold(token: str) -> str:
    """The token without marks, in ASCII where a letter has an ASCII form."""
    return "".join(FOLDED.get(c, c) for c in unicodedata.normalize("NFKD", token) if not unicodedata.category(c).startswith("M"))


class Analyzer:
    """A tokenizer and the filters applied to its tokens in order."""

    def __init__(self, tokenizer: str = "standard", filters: Sequence[str] = ("lowercase",), extra: dict[str, Any] | None = None) -> None:
        extra = dict(extra or {})
        self.tokenizer, self.filters = tokenizer, tuple(filters)
        if tokenizer in ("jieba", "jieba_accurate"):
            raise unsupported("no dictionary tokenizer is available")
        allowed = {"standard": {"max_token_length"}, "whitespace": set(), "ngram": {"ngram_min", "ngram_max", "token_chars"}}
        if tokenizer not in allowed:
            raise invalid(f"unknown tokenizer {tokenizer!r}")
        if bad := set(self.filters) - {"lowercase", "ascii_folding", "stemmer"}:
            raise invalid(f"unknown token filters {sorted(bad)}")
        if bad := set(extra) - allowed[tokenizer] - ({"stemmer_lang"} if "stemmer" in self.filters else set()):
            raise invalid(f"{tokenizer} tokenizer does not take {sorted(bad)}")
        self.language = extra.get("stemmer_lang", "english").lower()
        if self.language not in LANGUAGES:
            raise invalid(f"unknown stemmer language {self.language!r}")
        if "stemmer" in self.filters and self.language != "english":
            raise unsupported(f"no stemmer for {self.language}")
        self.longest = extra.get("max_token_length", 255)
        self.least, self.most = extra.get("ngram_min", 2), extra.get("ngram_max", 2)
        for n in (self.longest, self.least, self.most):
            if not isinstance(n, int) or n <= 0:
                raise invalid("lengths must be positive integers")
        if self.longest > MAX_TOKEN_LENGTH or self.least > self.most or self.most - self.least > MAX_NGRAM_RANGE:
            raise invalid("lengths out of range")
        self.classes = classes = extra.get("token_chars", [])
        if bad := set(classes) - set(CLASSES):
            raise invalid(f"unknown character classes {sorted(bad)}")
        self._runs = regex.compile("[" + "".join(CLASSES[c] for c in classes) + "]+" if classes else r"(?s).+")

    def tokens(self, text: str) -> list[str]:
        """The tokens of one text."""
        if self.tokenizer == "standard":
            out = [t[i : i + self.longest] for t in _ALNUM.findall(text) for i in range(0, len(t), self.longest)]
        elif self.tokenizer == "whitespace":
            out = [t for t in regex.split(r"\p{White_Space}+", text) if t]
        else:
            out = [run[i : i + n] for run in self._runs.findall(text) for i in range(len(run)) for n in range(self.least, self.most + 1) if i + n <= len(run)]
        for name in self.filters:
            if name == "lowercase":
                out = [t.lower() for t in out]
            elif name == "ascii_folding":
                out = [f for t in out if (f := fold(t))]
            else:
                out = [stemming.english(t) for t in out]
        return out

    def column(self, text: Column) -> Column:
        """The tokens of a text column; null for null."""
        if self.tokenizer in ("standard", "whitespace") and set(self.filters) <= {"lowercase"}:
            # A greedy repetition takes the pieces of a run that is too long, too.
            token = rf"[\p{{IsAlphabetic}}\p{{N}}]{{1,{self.longest}}}" if self.tokenizer == "standard" else r"[^\p{IsWhite_Space}]+"
            parts = F.regexp_extract_all(text, F.lit(token), F.lit(0))
            return F.transform(parts, F.lower) if self.filters else parts
        if self.tokenizer == "ngram" and not self.classes and set(self.filters) <= {"lowercase"}:
            # The characters are bound to a lambda's variable, so they are split once.
            grams = F.get(F.transform(F.array(F.split(text, "")), self._grams), F.lit(0))
            return F.transform(grams, F.lower) if self.filters else grams
        SparkSession.active().conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        return F.arrow_udf(_tokens_of(self), "array<string>")(text)

    def _grams(self, chars: Column) -> Column:
        """The n-grams of a text's characters, by place and then size."""

        def at(first: Column, i: Column) -> Column:
            # A null character is one behind the end, and so is its n-gram.
            return F.array(*(F.concat(first, *(F.get(chars, i + k) for k in range(1, n))) if n <= 8 else F.when(i + n <= F.size(chars), F.array_join(F.slice(chars, i + 1, n), "")) for n in range(self.least, self.most + 1)))

        return F.filter(F.flatten(F.transform(F.array_remove(chars, ""), at)), lambda g: g.isNotNull())


def _tokens_of(analyzer: Analyzer):
    def run(texts: pa.Array) -> pa.Array:
        # Of a few texts at a time are there tokens as objects of Python.
        made = [pa.array([None if t is None else analyzer.tokens(t) for t in texts.slice(i, PIECE).to_pylist()], pa.list_(pa.string())) for i in range(0, len(texts), PIECE)]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run
