"""Exact tokenisation by the tokenizers library, each distinct unit encoded once.

Pre-tokenizers of the two kinds known here never let a token cross certain places of a text, so a text is the concatenation
of units whose ids do not depend on their neighbours:

- byte level (no normalizer): a place before a blank that follows a visible character. Units are " word", "\\nword" and the
  like. Texts with any other white space, or with spaces in a row, are encoded whole.
- word level (white space collapses and is then dropped): words between ASCII white space.

Marks that end a word after a letter are a unit of their own, as both pre-tokenizers part letters from marks. A text that holds
the content of an added token (such as an end mark), which the library turns into that token's id, is encoded whole. Any other
tokenizer encodes whole texts. Texts are split and their units numbered by Arrow; only distinct units are looked up, in a
memo of two generations of at most MEMO_UNITS units (a unit met again moves to the young one, the old one is given up when
the young one is full), which bounds a worker's memory and changes no result. New units are encoded together, UNITS_AT_ONCE in a
text, with a sentinel between them whose token no unit contains. The ids of a text are gathered by number.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_UNITS = 300_000
LONGEST_UNIT = 64
#: New units that share one call of the library, whose tokens take many times the memory of their ids.
UNITS_AT_ONCE = 8192
ROUND_BYTES = 6 << 20
#: RE2 patterns. What makes a byte-level text be encoded whole; marks that end a word after A-Z, a-z or U+00C0 to U+00FF.
ODD_BLANKS = "[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200d}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]|^[ \\n]|  | \\n|\\n |\\n\\n| $"
END_MARKS = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:*#$%&|<>()]+)([ \\n]|$)"


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = [x["content"] for x in spec.get("added_tokens") or [] if x["content"]]
        self.kind = self._kind(spec)
        #: RE2 pattern of what makes any text be encoded whole: the added tokens, and what would be one when a unit is lower-cased.
        self.added = "|".join(re.sub(r"([^\w\s])", r"\\\1", x, flags=re.ASCII) for x in added)
        if self.kind == "word" and added:
            self.added = f"(?i:{self.added})"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        for x in spec.get("added_tokens") or []:
            # found in normalized text, or made where units are put together with blanks
            if (norm and x.get("normalized")) or not x["content"].isascii() or re.search(r"[\s\x00]", x["content"]):
                return "whole"
        if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        drops = any(x.get("type") == "Split" and x.get("invert") and x.get("behavior") == "Removed" and "\\s" in str(x.get("pattern")) for x in pre.get("pretokenizers", []))
        norms = {x.get("type") for x in (norm or {}).get("normalizers", [])}
        if steps == ["Split", "ByteLevel"] and drops and norms <= {"NFC", "Replace", "Lowercase"}:
            return "word"
        return "whole"

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit_lists(self, texts: pa.Array) -> pa.ListArray:
        """Keys of the units of each text. A byte-level key stands for itself with a space before it, unless it begins with
        a newline, or with a NUL mark for what has no blank before it."""
        if self.kind == "word":
            # lower-cases A-Z, as the normalizer does in any case
            return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), END_MARKS, "\\1 \\2\\3"))
        marked = pc.replace_substring_regex(texts, END_MARKS, "\\1 \x00\\2\\3")
        marked = pc.binary_join_element_wise(pa.scalar("\x00", texts.type), pc.replace_substring(marked, "\n", " \n"), pa.scalar("", texts.type))
        return pc.split_pattern(marked, " ")

    def _unit_text(self, key: bytes) -> str:
        if self.kind == "word" or key[:1] == b"\n":
            return key.decode()
        return key[1:].decode() if key[:1] == b"\x00" else " " + key.decode()

    def _encode_units(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each unit; those that can share a text are encoded in one."""
        if self.kind == "word":
            together = [u for u in units if b"0" not in u and u]
            sentinel, text = "0", b" 0 ".join(together).decode()
        else:
            together = [u for u in units if u[:1] not in (b"\x00", b"\n") and b"\n" not in u and u]
            sentinel, text = "\n", b"".join([b" ", b"\n ".join(together)]).decode()
        found: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode(sentinel, add_special_tokens=False).ids
        if len(together) > 1 and len(mark) == 1:
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == mark[0])
            if len(cuts) == len(together) - 1:
                packed = ids.tobytes()
                starts, ends = (np.concatenate([[0], cuts + 1]) * 4).tolist(), (np.concatenate([cuts, [len(ids)]]) * 4).tolist()
                found = {u: packed[a:b] for u, a, b in zip(together, starts, ends, strict=True)}
        rest = [u for u in units if u not in found]
        found.update(zip(rest, self._ids([self._unit_text(u) for u in rest]), strict=True))
        return found

    def _look_up(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, by way of the memo."""
        if len(self.young) + len(units) > MEMO_UNITS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, units))
        at = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in at:
            if (ids := old.get(units[i])) is None:
                new.append(units[i])
            else:
                young[units[i]] = out[i] = ids
        if new:
            found: dict[bytes, bytes] = {}
            for first in range(0, len(new), UNITS_AT_ONCE):
                found.update(self._encode_units(new[first : first + UNITS_AT_ONCE]))
            for i in at:
                if out[i] is None:
                    out[i] = found[units[i]]
            if len(found) <= MEMO_UNITS:
                young.update((k, v) for k, v in found.items() if len(k) <= LONGEST_UNIT)
        return out

    def _round(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if self.kind == "whole":
            whole = np.ones(len(texts), dtype=bool)
        elif self.kind == "word":
            whole = np.zeros(len(texts), dtype=bool)
        else:
            whole = pc.match_substring_regex(texts, ODD_BLANKS).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        if self.kind != "whole" and self.added:
            whole = whole | pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        split = texts if not whole.any() else texts.filter(pa.array(~whole))
        lists = self._unit_lists(split) if len(split) else None
        if lists is not None and len(lists.flatten()):
            coded = lists.flatten().dictionary_encode()
            packed = self._look_up(coded.dictionary.cast(pa.binary()).to_pylist())
            sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
            flat = np.frombuffer(b"".join(packed), dtype="<u4")
            at = coded.indices.to_numpy()
            lengths = sizes[at]
            ends = np.cumsum(lengths)
            small = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
            place = np.repeat(((np.cumsum(sizes) - sizes)[at] - (ends - lengths)).astype(small), lengths)
            place += np.arange(ends[-1], dtype=small)
            ids = flat[place]
            bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        else:
            ids, bounds = np.zeros(0, dtype="<u4"), np.zeros(len(split) + 1, dtype=np.int64)
        if not whole.any():
            return ids, np.diff(bounds)
        alone = iter(self._ids(texts.filter(pa.array(whole)).to_pylist()))
        pieces, k = [], 0
        for odd in whole.tolist():
            if odd:
                pieces.append(np.frombuffer(next(alone), dtype="<u4"))
            else:
                pieces.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(pieces), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, ids, counts) of runs of a column of texts without nulls: the place of the run's first text, all ids of its
        texts as unsigned 32-bit integers, and the number of ids of each. A run has about ROUND_BYTES of text."""
        texts = texts.cast(pa.string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROUND_BYTES, side="right")))
            yield (at, *self._round(texts.slice(at, upto - at)))
            pa.default_memory_pool().release_unused()
            at = upto


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text, and where each text then begins (one more entry than texts)."""
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(starts[-1], end_id, dtype="<u4")
    kept = np.ones(len(out), dtype=bool)
    kept[starts[1:] - 1] = False
    out[kept] = ids
    return out, starts


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each path and worker process."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, a default for the operators' path parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
