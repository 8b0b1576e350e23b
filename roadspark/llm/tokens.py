"""Token ids of whole texts by the tokenizers library, with a bounded memory of words already seen."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a Python worker remembers (some 30 bytes each) before it forgets all of them.
MEMORY_WORDS = 1_000_000
#: Words not yet known that are encoded as one text.
TOGETHER = 4096
#: Characters of text whose words are looked up together.
GROUP_CHARS = 6 << 20
END_ID = 0
#: A blank with another white-space character before it, and with one or the end behind it: there a token may span the blank.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SPANS = rf"{SPACE} ({SPACE}|\z)"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode(texts) gives, for each text, its ids as little-endian unsigned integers of `width` bytes.

    For a byte-level tokenizer that splits with its usual pattern, no token spans the place before a blank, unless white space surrounds it, so
    each blank-led word is encoded once and remembered: unknown words are encoded many at a time as one text, whose tokens fall
    apart by their bytes. Texts with a surrounded blank or the string of an added token, and every other kind of tokenizer, are encoded whole, as the
    library does it: it makes an added token of its string, unless plain_special makes it ordinary text.
    """

    def __init__(self, path: str, plain_special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.by_word = self.by_word and not any(re.search(r"\s", t) for t in added)
        self.whole = "|".join([SPANS, *(re.sub(r"(\W)", r"\\\1", t) for t in added)])
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.heads: dict[str, bytes] = {"": b""}
        if self.by_word:
            # In a byte-level vocabulary each character of a token stands for one byte.
            self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.token_bytes[i] = len(token)

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a blank before it, from one text of all of them."""
        raw = self._plain([" " + " ".join(words)])[0]
        ends = np.cumsum(self.token_bytes[np.frombuffer(raw, f"<u{self.width}")])
        want = np.cumsum([len(w.encode()) + 1 for w in words])
        cut = np.searchsorted(ends, want)
        if len(ends) == 0 or cut[-1] != len(ends) - 1 or (ends[cut] != want).any():
            return self._plain([" " + w for w in words])
        cut = ((cut + 1) * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def _places(self, words: pa.Array) -> pa.Array:
        """Where the ids of each of the distinct words are in self.ids; unknown words are encoded first."""
        if len(self.known) > MEMORY_WORDS:
            self.known, self.ids = self.known[:0], self.ids[:0]
        at = pc.index_in(words, value_set=self.known)
        if not at.null_count:
            return at
        unknown = words.filter(pc.is_null(at))
        new = unknown.to_pylist()
        ids: list[bytes] = []
        for k in range(0, len(new), TOGETHER):
            part = new[k : k + TOGETHER]
            ids += self._plain([" " + w for w in part]) if "" in part else self._words(part)
        fresh = pa.array(range(len(self.known), len(self.known) + len(new)), at.type)
        self.known, self.ids = pa.concat_arrays([self.known, unknown]), pa.concat_arrays([self.ids, pa.array(ids, pa.binary())])
        return pc.replace_with_mask(at, pc.is_null(at), fresh)

    def _plain(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [t.partition(" ") for t in texts]
        words = pc.split_pattern(pa.array([rest if blank else None for _, blank, rest in cut], pa.string()), " ")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        coded = words.flatten().dictionary_encode()
        places = self._places(coded.dictionary)
        ids = self.ids.take(places.take(coded.indices))
        at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[np.concatenate([[0], ends])].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = (ids.buffers()[2] or b"") if len(ids) else b""
        whole = memoryview(data)
        if len(self.heads) > MEMORY_WORDS // 16:
            self.heads = {"": b""}
        new = list({head for head, _, _ in cut} - self.heads.keys())
        self.heads.update(zip(new, self._plain(new), strict=True))
        return [b"".join((self.heads[head], whole[a:b])) for (head, _, _), a, b in zip(cut, at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._plain(texts)
        out: list[bytes | None] = [None] * len(texts)
        whole = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), self.whole).to_numpy(zero_copy_only=False)).tolist()
        for at in range(0, len(whole), 64):
            for i, ids in zip(whole[at : at + 64], self._plain([texts[i] for i in whole[at : at + 64]]), strict=True):
                out[i] = ids
        plain = [i for i, done in enumerate(out) if done is None]
        while plain:
            size, end = 0, 0
            while end < len(plain) and size < GROUP_CHARS:
                size += len(texts[plain[end]])
                end += 1
            for i, ids in zip(plain[:end], self._group([texts[i] for i in plain[:end]]), strict=True):
                out[i] = ids
            plain = plain[end:]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
