"""Byte-level BPE by the tokenizers library with a memo of space-bound words.

With the byte-level pattern a token never reaches over a single space or line break that stands between two other
characters, so a text is the concatenation of its words, each with the space or break before it, and equal words have
equal ids wherever they stand. Texts with other white space are cut only where that holds.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; later new words are encoded each time they come.
MEMO_WORDS = 150_000
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A word of letters below U+0250 and the commas and full stops after it: always one token group and at most one more.
_PLAIN = re.compile(r"([^\W\d_]+)([.,]*)")
#: White space that is not one space or line break between two words: the texts without it are cut by Arrow.
_ODD_SPACE = "\\A[ \n]|[ \n][ \n]|[ \n]\\z|[\t\x0b-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Characters from which on texts are cut and counted by Arrow.
LARGE = 50_000
#: New words that the tokenizer takes as one text.
JOINED = 200
_MISSING = repeat(-1)


def _regular(text: str) -> bool:
    """Every white space is one space or line break between two words."""
    words = text.split()
    gaps = len(words) - 1
    return sum(map(len, words)) == len(text) - gaps and text.count(" ") + text.count("\n") == gaps


def alphabet() -> list[str]:
    """The byte-level characters: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(c if c in shown else next(others)) for c in range(256)]


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, ranks: str | None = None, memo: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.byte = alphabet()
        n = self.tokenizer.get_vocab_size()
        back = {c: i for i, c in enumerate(self.byte)}
        tokens = [bytes(back[c] for c in self.tokenizer.id_to_token(i)) for i in range(n)]
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self._encode = _by_ranks(ranks, tokens) if ranks else None
        self.memo = memo
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.int32)
        self.used = self.words = 0
        self.start = np.empty(1 << 17, np.int64)
        self.count = np.empty(1 << 17, np.int64)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Memo keys of a text's words: "\\r" + word when nothing stands before it, else the word after its space or its break and word."""
        if not text:
            return []
        if not _regular(text):
            return ["\r" + p for p in _CUT.split(text)]
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\r" + out[0]
        return out

    @staticmethod
    def whole(key: str) -> str:
        return key[1:] if key[:1] == "\r" else key if key[:1] == "\n" else " " + key

    def _learn(self, keys: list[str]) -> np.ndarray:
        """Encodes new words and returns their numbers: with ranks plain ones as one text, which is cut into words again by
        the tokens' byte lengths. Words are remembered up to the limit; the others' ids last until the next call of encode."""
        if not self._encode:
            return self._learn_joined(keys)
        out = np.empty(len(keys), np.int64)
        for at in range(0, len(keys), 20_000):
            every, counts, plain, odd = [], [], [], []
            for i, key in enumerate(keys[at : at + 20_000], at):
                core = key[1:] if key[:1] in "\r\n" else key
                (plain if _PLAIN.fullmatch(core) and max(core) < "\u0250" and key[:1] != "\r" else odd).append(i)
            if plain:
                words = [self.whole(keys[i]) for i in plain]
                ids = np.array(self._encode("".join(words)))
                ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
                out[plain] = self._put([keys[i] for i in plain], ids, np.diff(ends, prepend=0))
            for i in odd:
                ids = self.tokenizer.encode(self.whole(keys[i]), add_special_tokens=False).ids
                every += ids
                counts.append(len(ids))
            if odd:
                out[odd] = self._put([keys[i] for i in odd], every, counts)
        return out

    def _learn_joined(self, keys: list[str]) -> np.ndarray:
        """Encodes new words, many at a time: a space or break stands before each, so as one text they keep their ids, and
        the tokens' byte lengths tell them apart. Words that begin a text, and any whose ends are not ends of tokens, go alone."""
        out = np.empty(len(keys), np.int64)
        alone = [i for i, k in enumerate(keys) if k[:1] == "\r"]
        together = np.delete(np.arange(len(keys)), alone)
        if len(together):
            plain = [k for k in keys if k[:1] != "\r"] if alone else keys
            words = [k if k[:1] == "\n" else " " + k for k in plain]
            texts = ["".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(pc.binary_length(pa.array(words, pa.large_string())).to_numpy().astype(np.int64))
            tokens = np.cumsum(self.lengths[ids])
            at = np.searchsorted(tokens, ends)
            if len(tokens) and tokens[-1] == ends[-1] and (tokens[at] == ends).all():
                out[together] = self._put(plain, ids, np.diff(at + 1, prepend=0))
            else:
                alone = list(range(len(keys)))
        if alone:
            ids = [self.tokenizer.encode(self.whole(keys[i]), add_special_tokens=False).ids for i in alone]
            out[alone] = self._put([keys[i] for i in alone], list(chain.from_iterable(ids)), list(map(len, ids)))
        return out

    def _put(self, keys: list[str], ids, counts) -> np.ndarray:
        """Stores ids of new words behind those there are and returns the words' numbers."""
        k, n = self.words, len(keys)
        if k + n > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * (k + n)), np.resize(self.count, 2 * (k + n))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[k : k + n] = counts
        self.start[k : k + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.words += n
        self.number.update(zip(keys[: max(0, self.memo - k)], range(k, self.memo)))
        return np.arange(k, k + n)

    def _forget(self) -> None:
        """Past the limit the memo keeps its first words, which hold the frequent ones."""
        self.words = len(self.number)
        self.used = int(self.start[self.words - 1] + self.count[self.words - 1]) if self.words else 0

    def _words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different memo keys of the texts, each word's place among them in text order, and each text's words."""
        if sum(map(len, texts)) < LARGE:
            lists = [self.pieces(t) for t in texts]
            number: dict[str, int] = {}
            which = [number.setdefault(k, len(number)) for k in chain.from_iterable(lists)]
            return list(number), np.array(which, np.int64), np.array([len(x) for x in lists], np.int64)
        a = pa.array(texts, pa.large_string())
        odd = pc.or_(pc.equal(a, ""), pc.match_substring_regex(a, _ODD_SPACE)).to_numpy(zero_copy_only=False)
        even = a.filter(pa.array(~odd))
        first, none = pa.scalar("\r", pa.large_string()), pa.scalar("", pa.large_string())
        even = pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(even, "\n", " \n"), none), " ")
        lists = [self.pieces(texts[i]) for i in np.flatnonzero(odd).tolist()]
        counts = np.empty(len(texts), np.int64)
        counts[~odd] = pc.list_value_length(even).to_numpy()
        counts[odd] = [len(x) for x in lists]
        coded = pa.concat_arrays([even.flatten(), pa.array(list(chain.from_iterable(lists)), pa.large_string())]).dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        if lists:  # those stand behind the others
            at = np.empty(len(texts), np.int64)
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            at[order] = np.cumsum(counts[order]) - counts[order]
            which = which[np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(len(which))]
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), which, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids. Texts are encoded together; empty ones have no ids."""
        keys, which, words = self._words(texts)
        number = self.number
        at = np.fromiter(map(number.get, keys, _MISSING), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = self._learn([keys[i] for i in missing.tolist()])
        at = at[which]
        count, start = self.count[at], self.start[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(start - (ends - count), count) + np.arange(total)]
        if self.words > len(number):
            self._forget()
        at_ends, bounds = np.append(0, ends), np.append(0, np.cumsum(words))
        return ids, (at_ends[bounds[1:]] - at_ends[bounds[:-1]]).astype(np.int64)


def _by_ranks(path: str, tokens: list[bytes]):
    """A faster encoder of plain words for the same vocabulary as ranks; refuses ranks that differ from it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if any(tokens[i] != x for x, i in ranks.items()) or len(ranks) + 1 != len(tokens):
        raise ValueError(f"{path} holds another vocabulary")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_encoders: dict[tuple[str, str | None, int], Encoder] = {}


def encoder(path: str, ranks: str | None = None, memo: int = MEMO_WORDS) -> Encoder:
    """The worker's encoder of a vocabulary file, read once. With the vocabulary's rank file new words are faster."""
    if (path, ranks, memo) not in _encoders:
        _encoders[path, ranks, memo] = Encoder(path, ranks, memo)
    return _encoders[path, ranks, memo]
