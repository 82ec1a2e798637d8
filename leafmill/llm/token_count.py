"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

Byte-pair encodings have one valid split per string, and a split is valid exactly if each pair of
neighbouring tokens is what the encoder makes of the two alone. So the last token of every prefix,
and with it the token count of every prefix, follows from shorter prefixes in one pass: of the tokens
that end a prefix, the one that gets on with the last token of the prefix before it. One table
answers how many tokens any cut has and where a budget of tokens ends, without encoding again.

No piece of the vocabulary has a space mark behind another character and none has a newline, so the
passes run over blank-separated chunks and counts add up; chunks repeat and are kept per worker, in
two generations of a fixed number of entries.

Defined cases: null or empty text has 0 tokens, 0 bytes and the one-entry table [0]; characters that
the vocabulary lacks count their UTF-8 bytes; ids may be null or repeat; a chunk of any length takes
time in proportion to it; an empty table gives an empty result; repeated rows give repeated rows; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n")
LIMIT = 4096
#: Chunks kept per worker and generation, and the longest one that is kept.
KEPT, KEPT_CHARS = 250_000, 64


class Vocabulary:
    """Pieces of a sentencepiece BPE model and the tables of the dynamic programme."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece crosses a space mark or newline; chunks would not add up")
        self.longest = max(map(len, self.score))
        #: Pieces end alike in many prefixes: lengths of pieces by their last two characters.
        self.lengths: dict[str, list[int]] = {}
        for p in self.score:
            if len(p) > 1:
                known = self.lengths.setdefault(p[-2:], [])
                if len(p) not in known:
                    known.append(len(p))
        for known in self.lengths.values():
            known.sort(reverse=True)
        self.agrees: dict[tuple[str, str], bool] = {}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """The encoder on a short string: joins the best-scored neighbours, leftmost first, to the end."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.agrees.get(pair)
        if known is None:
            if len(self.agrees) >= 1_000_000:
                self.agrees.clear()
            known = self.agrees[pair] = self.merged(left + right) == [left, right]
        return known

    def prefixes(self, chunk: str) -> list[int]:
        """Token counts of chunk[:0], chunk[:1], ... chunk."""
        n = len(chunk)
        count, last = [0] * (n + 1), [""] * (n + 1)
        score, lengths, agrees = self.score, self.lengths, self.agrees
        for end in range(1, n + 1):
            for size in lengths.get(chunk[end - 2 : end], ()) if end > 1 else ():
                start = end - size
                if start < 0:
                    continue
                piece = chunk[start:end]
                if piece in score:
                    if start:
                        known = agrees.get((last[start], piece))
                        if not (self.fits(last[start], piece) if known is None else known):
                            continue
                    count[end], last[end] = count[start] + 1, piece
                    break
            else:
                c = chunk[end - 1]
                count[end], last[end] = count[end - 1] + (1 if c in score else len(c.encode("utf-8", "surrogatepass"))), c
        return count

    def __getitem__(self, chunk: str) -> int:
        """Tokens of a whole chunk."""
        n = self.young.get(chunk)
        if n is None:
            n = self.old.get(chunk)
            if n is None:
                n = self.prefixes(chunk)[-1]
            if len(chunk) <= KEPT_CHARS:
                if len(self.young) >= KEPT:
                    self.young, self.old = {}, self.young
                self.young[chunk] = n
        return n

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = self.chunks(text)
        try:
            return sum(map(self.young.__getitem__, chunks))
        except KeyError:
            return sum(map(self.__getitem__, chunks))

    def count_and_cut(self, text: str | None, limit: int) -> tuple[int, int]:
        """Tokens of the text, and characters of its longest prefix of at most ``limit`` tokens.

        Whole chunks only add tokens, so that prefix ends in the first chunk that brings the text over the limit;
        inside it a longer prefix can have fewer tokens, so its last fitting one is taken.
        """
        if not text:
            return 0, 0
        chunks = self.chunks(text)
        try:
            whole = sum(map(self.young.__getitem__, chunks))
        except KeyError:
            whole = sum(map(self.__getitem__, chunks))
        if whole <= limit:
            return whole, len(text)
        total = at = 0
        for chunk in chunks:
            n = self[chunk]
            if total + n > limit:
                break
            total, at = total + n, at + len(chunk)
        last = max(j for j, k in enumerate(self.prefixes(chunk)) if total + k <= limit)
        return whole, max(0, at + last - 1)  # the mark before the text is no character of it

    def table(self, text: str | None) -> np.ndarray:
        """int32 counts of every prefix of the text, by code points, from the empty one on."""
        if not text:
            return np.zeros(1, np.int32)
        out, total = [np.zeros(1, np.int32)], 0
        for chunk in self.chunks(text):
            counts = np.array(self.prefixes(chunk)[1:], np.int32) + total
            total = int(counts[-1])
            out.append(counts)
        whole = np.concatenate(out)
        return np.concatenate([np.zeros(1, np.int32), whole[2:]])  # the mark before the text is no character of it


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker; workers serve many tasks."""
    return Vocabulary(path)


def token_counts(docs: DataFrame, model_path: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars.

    n_tokens is the last entry of the text's prefix table; cut_chars are the characters of its longest prefix of at
    most ``limit`` tokens, from the table of the chunk in which that ends.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in batches:
            found = [v.count_and_cut(t, limit) for t in b.column("text").to_pylist()]
            n, cut = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "cut_chars"])

    source = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = source.mapInArrow(counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, cut_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars")


def with_prefix_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ``prefix_tokens``, an array<int> of the token count at every prefix of ``text``."""

    @F.pandas_udf("array<int>")
    def table(texts: pd.Series) -> pd.Series:
        v = vocabulary(model_path)
        return pd.Series([v.table(t) for t in texts])

    return docs.withColumn("prefix_tokens", table("text"))


def tokens_until(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters; of the whole text if it is shorter."""
    return F.element_at(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1) + 1)


def chars_within(prefix_tokens: Column, budget: Column) -> Column:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fitting = F.filter(F.sequence(F.lit(0), F.size(prefix_tokens) - 1), lambda i: F.element_at(prefix_tokens, i + 1) <= budget)
    return F.array_max(fitting)
