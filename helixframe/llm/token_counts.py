"""Operator 13, exact token counts of every prefix by dynamic programming.

For each document a table holds how the count of tokens changes from each prefix of the text to the
next (a prefix ends between two code points), as compressed differences. Questions on truncation
and budgets are answered from that table: no text is encoded again.

The tokenizer is a byte-pair encoder that marks word ends. Inside a word the last token of each
prefix follows from those of shorter prefixes: a sequence is what the merges make of a text just if
they leave each pair of neighbours as it is, so the last token is the one vocabulary entry that ends
there and gets on with the last token before it. A prefix that ends inside a word needs one more
step, as its last token carries the word-end mark. Words repeat, so a worker remembers the
differences of those it met. White space is never part of a token.

Defined results: null text counts as empty, an empty text has no tokens; special strings inside texts
are one token each, as the library's default has it, and prefixes that end within one read it as
ordinary text; null and repeated ids stay as they are; an empty table gives no rows; extra columns
are ignored. Texts count whole. Memory grows with one text. Work grows with its length, but for
marks that combine with the letter before them: there it grows with the square of the marks of a letter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import shared_folder, spread, written

#: White space of the tokenizer's patterns: never part of a word.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the tokenizer cuts text into words (fixed value of its file, which is compared).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs without white space that a worker remembers, and the characters of the longest one; pairs of tokens that it remembers.
CACHE_RUNS, CACHE_CHARS, CACHE_PAIRS = 800_000, 40, 500_000
LIMIT = 2048
_counters: dict[str, "PrefixCounter"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Differences of token counts between the prefixes of a text."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        cut = [x.get("pattern", {}).get("Regex") for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or WORDS not in cut:
            raise ValueError(f"{path} is not a byte-pair encoder with word ends and the words known here")
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.made = {"".join(m): (*m, i) for m, i in self.ranks.items()}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.tokens = ahocorasick.Automaton()
        for token in {t.removesuffix("</w>") for t in model["vocab"]}:
            self.tokens.add_word(token, (token, token + "</w>" if token + "</w>" in model["vocab"] else ""))
        self.tokens.make_automaton()
        self.inner = {t for t in model["vocab"] if not t.endswith("</w>")}
        special = sorted((x["content"] for x in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.letters = byte_letters()
        self.words = regex.compile(WORDS)
        self.ascii_words = re.compile(WORDS.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)  # after lower-casing
        self.runs = re.compile(f"([{WHITE_SPACE}]+)")
        self.kept: dict[str, bytes] = {}
        self.words_kept: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # second characters of canonical pairs join what stands before them, as combining marks do
        codes = (unicodedata.decomposition(chr(c)).split() for c in range(0xA0, 0x30000))
        self.joining = {chr(int(x[1], 16)) for x in codes if len(x) == 2 and not x[0].startswith("<")} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}

    @classmethod
    def of(cls, path: str) -> "PrefixCounter":
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def merged(self, symbols: list[str]) -> list[str]:
        """What the merges make of the symbols: always the first of the pairs with the best rank."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def stands(self, one: str, two: str) -> bool:
        """Whether the merges leave token two as it is after token one (or at the start: one is empty)."""
        known = self.pairs.get((one, two))
        if known is None:
            if not two.endswith("</w>") and two not in self.inner:
                known = False
            elif one:
                known = self.stands("", two) and not self.crossed(one, two)
            else:
                known = self.merged([*two[:-5], two[-5:]] if two.endswith("</w>") else list(two)) == [two]
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[one, two] = known
        return known

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at that side (0: left, 1: right) while the token grows, each with the rank of the merge that takes it in."""
        held = self.edges.get((token, side))
        if held is None:
            held, at, until = [], token, len(self.ranks)
            while at in self.made:
                held.append((at, until))
                until = self.made[at][2]
                at = self.made[at][side]
            held.append((at, until))
            self.edges[token, side] = held
        return held

    def crossed(self, one: str, two: str) -> bool:
        """Whether a merge over their border comes before what it joins is taken in (of equal ranks the left one comes first)."""
        ranks = self.ranks
        for left, until_left in self.edge(one, 1):
            for right, until_right in self.edge(two, 0):
                rank = ranks.get((left, right))
                if rank is not None and rank < until_left and rank <= until_right:
                    return True
        return False

    def word(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, after its first, second, .. code point."""
        if word.isascii() and word.isprintable():
            s, ends = word, None
        else:
            letters = [[self.letters[b] for b in c.encode("utf-8", "replace")] for c in word]
            s, ends = "".join(x for c in letters for x in c), set(accumulate(map(len, letters)))
        pairs, stands = self.pairs, self.stands
        counts, last, out, inner, final = [0] * (len(s) + 1), [""] * (len(s) + 1), [], 0, 0
        for i, (token, ended) in self.tokens.iter(s):  # all entries that end at each place, the longest first
            end = i + 1
            at = end - len(token)
            before = last[at]
            if final < end and ended and (ends is None or end in ends) and (pairs[before, ended] if (before, ended) in pairs else stands(before, ended)):
                out.append(counts[at] + 1)
                final = end
            if inner < end and (pairs[before, token] if (before, token) in pairs else stands(before, token)):
                counts[end], last[end], inner = counts[at] + 1, token, end
        return out

    def normal(self, text: str) -> list[int]:
        """Tokens of each prefix of text as the normalizer leaves it (no white space)."""
        out, base = [], 0
        kept = self.words_kept
        for word in self.ascii_words.findall(text) if text.isascii() else self.words.findall(text):
            counts = kept.get(word)
            if counts is None:
                if len(kept) > CACHE_RUNS:
                    kept.clear()
                counts = self.word(word)
                if len(word) <= CACHE_CHARS:
                    kept[word] = bytes(counts)  # at most four tokens a character
            if word in ("'re", "'ve", "'ll"):  # one word when it is whole, two before
                counts = [counts[0], self.word(word[0])[-1] + self.word(word[1])[-1], *counts[2:]]
            out += [base + c for c in counts]
            base = out[-1]
        return out

    def plain(self, text: str) -> list[int]:
        """Tokens of each prefix of a run without white space and special strings."""
        if text.isascii():
            return self.normal(text.lower())
        if unicodedata.is_normalized("NFC", text) and "\u0130" not in text:  # so are all prefixes; only this letter gets longer
            return self.normal(self.lowered(text))
        groups: list[str] = []
        for c in text:
            if groups and (unicodedata.combining(c) or c in self.joining):
                groups[-1] += c
            else:
                groups.append(c)
        done = [self.lowered(g) for g in groups]
        counts, whole, at, out = [0, *self.normal("".join(done))], "".join(done), 0, []
        for group, after in zip(groups, done):
            for k in range(1, len(group) + 1):
                part = after if k == len(group) else self.lowered(group[:k])
                if whole.startswith(part, at) and (part == after or unicodedata.is_normalized("NFC", group)):
                    out.append(counts[at + len(part)])
                else:  # the marks still to come change the letter: count it as it is without them
                    starts = [m.start() for m in self.words.finditer(whole[:at])][-2:]
                    start = starts[0] if starts else 0
                    out.append(counts[start] + self.normal(whole[start:at] + part)[-1])
            at += len(after)
        return out

    @staticmethod
    def lowered(text: str) -> str:
        """Composed and in lower case, each code point by itself (so there is no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def run(self, text: str) -> list[int]:
        """Tokens of each prefix of a run without white space."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        out, base = [], 0
        for i in range(0, len(parts), 2):
            own, special = parts[i], parts[i + 1] if i + 1 < len(parts) else ""
            counts = self.plain(own + special[:-1])
            out += [base + c for c in counts]
            base += counts[len(own) - 1] if own else 0
            if special:
                base += 1
                out.append(base)
        return out

    def changes(self, text: str) -> np.ndarray:
        """The change of the count at each code point: int8, or int32 where a change is larger."""
        runs, kept = self.runs.split(text), self.kept
        try:
            return np.frombuffer(b"".join(map(kept.__getitem__, runs)), np.int8)
        except KeyError:
            pass
        if len(kept) > CACHE_RUNS:
            kept.clear()
        own: dict[str, bytes | list[int]] = {}
        small = True
        for i, r in enumerate(runs):
            if r in kept or r in own:
                continue
            steps = bytes(len(r))
            if r and not i % 2:
                counts = self.run(r)
                steps = [a - b for a, b in zip(counts, [0, *counts])]
                if max(steps) < 128 and min(steps) >= -128:
                    steps = bytes([x & 255 for x in steps])
            if isinstance(steps, bytes) and len(r) <= CACHE_CHARS:
                kept[r] = steps
            else:
                own[r] = steps
                small = small and isinstance(steps, bytes)
        found = [kept[r] if r in kept else own[r] for r in runs]
        if small:
            return np.frombuffer(b"".join(found), np.int8)
        return np.concatenate([np.frombuffer(x, np.int8).astype(np.int32) if isinstance(x, bytes) else np.array(x, np.int32) for x in found])


def packed(changes: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(changes.tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    """Tokens of the prefixes of 0, 1, .. code points."""
    import zstandard

    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int8 if width == 1 else np.int32)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def count_prefixes(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table (id, n_bytes, n_chars, n_tokens, width, changes): the counts of all prefixes of each text, as written in the folder."""
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(2):
                steps = counter.changes(text.as_py())
                rows.append((len(steps), int(steps.sum(dtype=np.int64)), steps.itemsize, packed(steps)))
            columns = zip(*rows) if rows else [[]] * 4
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "n_bytes", "n_chars", "n_tokens", "width", "changes"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = spread(df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")))
    made = texts.mapInArrow(count, f"id {kind}, n_bytes long, n_chars long, n_tokens long, width int, changes binary")
    return written(made, folder or shared_folder(df.sparkSession), "prefix_counts")


def _answer(f) -> Column:
    """A column function of (changes, width, number) by f(counts of all prefixes, number)."""

    def answer(changes, width, number):
        import pandas as pd

        return pd.Series([None if pd.isna(x) else f(unpacked(c, w), int(x)) for c, w, x in zip(changes, width, number)], dtype="Int64")

    return F.pandas_udf(answer, "long", F.PandasUDFType.SCALAR)


def tokens_of_prefix(chars: Column) -> Column:
    """On a table of count_prefixes: tokens of the first so many code points (fewer: of all; null stays null)."""
    return _answer(lambda counts, k: int(counts[min(max(k, 0), len(counts) - 1)]))(F.col("changes"), F.col("width"), chars)


def longest_prefix(tokens: Column) -> Column:
    """On a table of count_prefixes: the most code points whose prefix has at most so many tokens (null stays null).

    Counts of prefixes may fall as well as rise (a word that becomes whole can be one token), so the last such prefix is taken.
    """
    return _answer(lambda counts, most: int(np.flatnonzero(counts <= max(most, 0))[-1]))(F.col("changes"), F.col("width"), tokens)


def token_counts(df: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit, and fit_chars, the code points of its longest prefix within the limit."""
    held = count_prefixes(df, tokenizer, None, id_col, text_col)
    return held.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), longest_prefix(F.lit(limit)).alias("fit_chars"))
