"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be bridged by a
merge: the place between the two bytes is a certain cut. A pre-token is cut at
all such places, the fragments are encoded on their own and their ids
concatenated. The pair table tells pairs that end a word-final token from
pairs further inside, so the last pair of a pre-token is tested against the
former and the others against the latter.

ASCII white space cuts a text before anything else: the tokenizer drops white
space, and neither its normaliser nor its pre-tokeniser reaches across it. The
ids of such words, of pre-tokens and of fragments are memoised by the worker.
Normalising and pre-tokenising use the tokenizer's own components, but for
words of ASCII signs and the letters U+00C0 to U+00FF, which composition leaves
alone: those are lower-cased and matched with the file's pattern here. Merges
run here.

Decoding works from the ids alone: the tokens of the ids joined by the file's
decoder (this vocabulary has none, so with single spaces), special tokens
included.

Defined cases: a null text is empty; an empty text has no ids and decodes to
the empty string; a special token's string in a text becomes its id; repeated
rows are encoded each; very long words cost n log n merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.cache import Memo

#: Words, pre-tokens and fragments that a worker keeps (twice as many at most).
WORDS, PRE_TOKENS, FRAGMENTS = 200_000, 80_000, 30_000
_workers: dict[str, "ForcedBoundaryBPE"] = {}


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return out


#: Fragments up to this length are merged without a heap.
SHORT = 40
_ID = 24
_MASK = (1 << _ID) - 1
_NO_MERGE = 1 << 62
#: Words that normalising only lower-cases.
_SIMPLE = re.compile("[!-~\u00c0-\u00ff]+")


def _simple_pattern(spec: dict):
    """The file's pre-token pattern, if it composes, lower-cases and matches, and nothing else."""
    import regex
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return None
    split, level = parts
    if spec["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} \
            or not split["invert"] or split["behavior"] != "Removed" or level["use_regex"] or level["add_prefix_space"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


class ForcedBoundaryBPE:
    """Encoder and decoder of a tokenizer file with a BPE model and an optional word end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") \
                or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only plain BPE models without a decoder are supported")
        tok = Tokenizer.from_file(path)
        self.normalise = tok.normalizer.normalize_str if tok.normalizer else str
        self.pre_tokens = tok.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        # Pair of ids → rank and id of the merge, each packed into one integer.
        self.rank: dict[int, int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[self.vocab[a] << _ID | self.vocab[b]] = i << _ID | self.vocab[a + b]
        if any(c + e not in self.vocab for c in byte_letters().values() for e in ("", self.end)):
            raise ValueError("the vocabulary must hold all 256 bytes")
        self.inner, self.last = self._pairs()
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be literal")
        if any(not t["content"] or len(t["content"].encode().split()) != 1
               or t["content"] != t["content"].strip() for t in added):
            raise ValueError("added tokens must be words: texts are split at white space first")
        self.added = {t["content"]: t["id"] for t in added}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        # A word without any of their first characters holds no added token.
        self.marks = re.compile("[" + "".join(re.escape(c) for c in sorted({t[0] for t in self.added})) + "]") if longest else None
        self.literal = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.simple = _simple_pattern(spec)
        self.letters = byte_letters()
        self.fragments = Memo(self._merge, FRAGMENTS)
        self.known = Memo(self._pre_token, PRE_TOKENS)
        self.words = Memo(self._word, WORDS)
        self.spoken = [self.token.get(i, "").encode() for i in range(max(self.token, default=-1) + 1)]

    def _pairs(self) -> tuple[set[str], set[str]]:
        """Neighbouring letters inside tokens: anywhere, and at the end of word-final tokens."""
        inner, last = set(), set()
        for token in self.vocab:
            final = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            body = token[:-len(self.end)] if final else token
            pairs = [body[i:i + 2] for i in range(len(body) - 1)]
            if final and pairs:
                last.add(pairs.pop())
            inner.update(pairs)
        return inner, last if self.end else inner

    def cut(self, pre_token: str) -> list[str]:
        """Fragments of a pre-token between certain cuts."""
        n, inner = len(pre_token), self.inner
        at = [i + 1 for i in range(n - 2) if pre_token[i:i + 2] not in inner]
        if n > 1 and pre_token[n - 2:] not in self.last:
            at.append(n - 1)
        if not at:
            return [pre_token]
        return [pre_token[a:b] for a, b in zip([0, *at], [*at, n], strict=True)]

    def _merge_short(self, parts: list[int]) -> tuple[int, ...]:
        """Merges of a few letters: the list of pairs is searched each time."""
        get = self.rank.get
        pairs = [get(a << _ID | b, _NO_MERGE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == _NO_MERGE:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [best & _MASK]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] << _ID | parts[i + 1], _NO_MERGE)
            if i:
                pairs[i - 1] = get(parts[i - 1] << _ID | parts[i], _NO_MERGE)
        return tuple(parts)

    def _merge(self, key: tuple[str, bool]) -> tuple[int, ...]:
        """Ids of one fragment; ``key[1]``: it ends its pre-token."""
        text, final = key
        parts: list[int | None] = [self.vocab[c] for c in text]
        if final:
            parts[-1] = self.vocab[text[-1] + self.end]
        n, rank = len(parts), self.rank
        if n <= SHORT:
            return self._merge_short(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i) for i in range(n - 1)
                if (found := rank.get(parts[i] << _ID | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            found, i = heapq.heappop(heap)
            left, j = parts[i], after[i]
            if left is None or j >= n or rank.get(left << _ID | parts[j]) != found:
                continue
            joined = found & _MASK
            parts[i], parts[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get(joined << _ID | parts[k])
                if found is not None:
                    heapq.heappush(heap, (found, i))
            h = before[i]
            if h >= 0:
                found = rank.get(parts[h] << _ID | joined)
                if found is not None:
                    heapq.heappush(heap, (found, h))
        return tuple(p for p in parts if p is not None)

    def _pre_token(self, pre_token: str) -> tuple[int, ...]:
        pieces = self.cut(pre_token)
        if len(pieces) == 1:                # kept as a pre-token: no second entry as a fragment
            return self._merge((pre_token, True))
        out: tuple[int, ...] = ()
        for p in pieces[:-1]:
            out += self.fragments[p, False]
        return out + self.fragments[pieces[-1], True]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.simple and _SIMPLE.fullmatch(text):
            for found in self.simple.findall(text.lower()):
                out += self.known[found if found.isascii() else found.encode().decode("latin-1").translate(self.letters)]
            return out
        for pre_token, _ in self.pre_tokens(self.normalise(text)):
            out += self.known[pre_token]
        return out

    def _word(self, word: bytes) -> bytes:
        text, ids, at = word.decode(), [], 0
        if self.literal and self.marks.search(text):
            for m in self.literal.finditer(text):
                ids += self._plain(text[at:m.start()])
                ids.append(self.added[m.group()])
                at = m.end()
        ids += self._plain(text[at:] if at else text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, text.split()))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; special tokens are kept."""
        return b" ".join(map(self.spoken.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def worker(tokenizer: str) -> ForcedBoundaryBPE:
    """The worker's encoder; a bare file name is looked up among the worker's own public tokenizers."""
    if tokenizer not in _workers:
        path = tokenizer
        if os.sep not in tokenizer:
            import public_tokenizers
            path = public_tokenizers.path(tokenizer)
        _workers[tokenizer] = ForcedBoundaryBPE(path)
    return _workers[tokenizer]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless turned off, ids and decoded.

    A map over the texts: no shuffle, one document in memory at a time besides
    the Arrow batch.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    more = [c for c, on in (("ids array<int>", ids), ("decoded string", decoded)) if on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            digests: list[tuple[int, str, str]] = []
            all_ids, all_decoded = [], []
            for i in range(batch.num_rows):
                found = bpe.encode(texts[i].as_py() or b"")
                spoken = bpe.decode(found)
                digests.append((len(found) // 4, hashlib.sha256(found).hexdigest(),
                                hashlib.sha256(spoken).hexdigest()))
                if ids:
                    all_ids.append(found)
                if decoded:
                    all_decoded.append(spoken)
            n, first, second = zip(*digests, strict=True) if digests else ((), (), ())
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()),
                    "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
            if ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.frombuffer(b"".join(all_ids), "<i4")))
            if decoded:
                cols["decoded"] = pa.array(all_decoded, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", "n_tokens long", "ids_sha256 string",
                                           "decoded_sha256 string", *more]))
