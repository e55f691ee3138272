"""Token ids of whole texts by a public tokenizer file, for use inside tasks.

The library spends its time on splitting and on merging; most words of a text have been seen
before. So the ids of white-space-separated runs of characters are kept, the runs of a batch
are told apart by Arrow's own functions, and the library only encodes words that are new,
many in one call. This holds for files with the normalizer and splitter named below, which
never join characters across white space and treat the words of a run one by one, and for
texts of Latin letters and common signs. Other texts are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from mediaframe.llm.common import kept_by

#: Runs kept per worker; an entry takes about 200 bytes.
KEPT_RUNS = 200_000
#: The normalizers and the splitter of files that are encoded by words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What makes a text odd: special tokens' strings, white space outside ASCII and the controls near it, a capital that lower-cases to two characters, and all but Latin letters and general punctuation.
ODD = "<\\||[\x1c-\x1f\x85\xa0\u0130\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]"
#: Commas and stops that stand alone after a letter or digit may be cut off from their words; these texts have others.
ATTACHED = r"[^\pL\pN\s][.,]\s"
_ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_latin_words = regex.compile(SPLIT).findall
#: The letters that byte-level vocabularies use for bytes without a printable Latin-1 letter.
_UNPRINTABLE = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(_UNPRINTABLE)}


def joined(cut: pa.ListArray, known: dict[str, bytes], learn) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists of runs and where each list's begin, with the end of the last. known: ids by
    run, as little-endian unsigned 32-bit bytes; learn(runs) adds those that it lacks."""
    bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    coded = cut.flatten().dictionary_encode()
    own = coded.dictionary.to_pylist()
    found = list(map(known.get, own))
    new = [k for k, ids in enumerate(found) if ids is None]
    learn([own[k] for k in new])
    for k in new:
        found[k] = known[own[k]]
    size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4")
    at = coded.indices.to_numpy()
    size, start = size[at], start[at]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    ids, cuts = pool[place], np.concatenate([[0], ends])[bounds]
    pa.default_memory_pool().release_unused()
    return ids, cuts


class Words:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_words = (
            (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
            and [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"][1:]] == ["ByteLevel"]
            and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        self.runs: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (unsigned 32-bit) and where each text's begin, with the end of the last. A null text counts as empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd))
        ids, cuts = self._plain(plain) if len(plain) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        if not odd.any():
            return ids, cuts
        rest = iter(np.split(ids, cuts[1:-1]) if len(plain) else [])
        parts = [self.whole(t.as_py()) if o else next(rest) for t, o in zip(texts, odd.tolist(), strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() with end_id after each text's ids."""
        ids, cuts = self.encode(texts)
        return np.insert(ids, cuts[1:], end_id).astype("<u4", copy=False), cuts + np.arange(len(cuts))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        low = pc.utf8_lower(texts)
        apart = pc.replace_substring(pc.replace_substring(low, ", ", " , "), ". ", " . ")
        cut = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, ATTACHED), low, apart))
        if len(self.runs) > KEPT_RUNS:
            self.runs = {"": b""}
        return joined(cut, self.runs, self._learn)

    def _learn(self, new: list[str]) -> None:
        """new: lower-cased runs without white space, none of them in self.runs."""
        single, cut = [], {}
        for run in new:
            words = _ascii_words(run) if run.isascii() else _latin_words(run)
            if len(words) == 1:
                single.append(run)
            else:
                cut[run] = words
        self._learn_words(single)
        self._learn_words([w for w in set().union(*cut.values()) if w not in self.runs])
        get = self.runs.__getitem__
        for run, words in cut.items():
            self.runs[run] = b"".join(map(get, words))

    def _learn_words(self, new: list[str]) -> None:
        tokenize, runs = self.library.model.tokenize, self.runs
        for w in new:
            ids = [t.id for t in tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTE_LETTERS))]
            runs[w] = struct.pack(f"<{len(ids)}I", *ids)


def words(path: str) -> Words:
    """The tokenizer of this worker process."""
    loaded = kept_by("tokens")
    if path not in loaded:
        loaded[path] = Words(path)
    return loaded[path]


def slices(batch: pa.RecordBatch, most_bytes: int = 2_000_000):
    """An Arrow batch in parts of about that size at most, of a row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(n, int(n * most_bytes / max(1, batch.nbytes))))
    for k in range(0, n, step):
        yield batch.slice(k, step)


def in_slices(batch: pa.RecordBatch, most_bytes: int = 4_000_000):
    """The same as lists of Python values, one for each column."""
    for part in slices(batch, most_bytes):
        yield [c.to_pylist() for c in part.columns]
