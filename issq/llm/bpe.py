"""Exact token counts and ids by library tokenizers, word by word.

``WordCoder`` encodes every distinct unit once and keeps the result under its
64-bit hash; a text is then put together with numpy. A unit is a word, or its
trailing punctuation where a letter stands before it (no token spans the two). This needs a
tokenizer whose tokens never reach across ASCII white space, which holds for
models that drop white space and mark word ends (checked when it is loaded);
other models encode whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from issq.llm import textkernel as tk

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Punctuation that is split from the end of a word. None of it is in a special
#: token, and a run of it makes tokens of its own.
_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[[ord(c) for c in ".,;:!?*$%&#"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Distinct words joined into one text when new ones are encoded.
JOIN = 256
#: Bytes of word prefixes encoded at a time.
PREFIX_BYTES = 1 << 20
#: Distinct words kept by a coder before it starts afresh.
CACHE_WORDS = 400_000
#: Ids kept by a coder before it starts afresh.
CACHE_IDS = 8_000_000
_coders: dict[str, "WordCoder"] = {}


def coder(path: str) -> "WordCoder":
    """One coder per Python worker and file."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def splits_at_spaces(config: dict) -> bool:
    """Whether encoding word by word gives the same ids: white space is only
    dropped, no added token holds or strips any, and BPE marks word ends."""
    dropped = any(
        p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "\\s" in p["pattern"].get("Regex", "")
        for p in (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    )
    added = all(not any(a[k] for k in ("lstrip", "rstrip", "single_word")) and not any(c.isspace() for c in a["content"]) for a in config.get("added_tokens", []))
    return bool(dropped and added and config["model"].get("end_of_word_suffix") and not config.get("post_processor"))


class WordCoder:
    def __init__(self, path: str):
        self.path, self.by_word = path, False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
            self.by_word = splits_at_spaces(config)
            suffix = config["model"].get("end_of_word_suffix") or "\0"
            vocabulary = model.get_vocab(with_added_tokens=True)
            self._closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            self._closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self._hash = np.zeros(0, dtype=np.uint64)  # sorted
        self._slot = np.zeros(0, dtype=np.int64)
        self._off = np.zeros(1, dtype=np.int64)
        self._ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str], plain: np.ndarray) -> None:
        """Encode new units; plain ones (letters only, so one pre-token whose
        last id closes a word) many to a text, told apart by closing ids."""
        joined = np.flatnonzero(plain)
        groups = [joined[i : i + JOIN] for i in range(0, len(joined), JOIN)]
        got = [np.asarray(x, dtype=np.uint32) for x in self._encode([" ".join([words[k] for k in g]) for g in groups])]
        lens = np.zeros(len(words), dtype=np.int64)
        alone = np.flatnonzero(~plain).tolist()
        flat_parts, order = [], []
        for g, ids in zip(groups, got):
            stops = np.flatnonzero(self._closes[ids]) + 1
            if len(stops) == len(g) and (not len(ids) or stops[-1] == len(ids)):
                lens[g] = np.diff(stops, prepend=0)
                flat_parts.append(ids)
                order.append(g)
            else:
                alone += g.tolist()
        for k, ids in zip(alone, self._encode([words[k] for k in alone])):
            lens[k] = len(ids)
            flat_parts.append(np.asarray(ids, dtype=np.uint32))
        order.append(np.asarray(alone, dtype=np.int64))
        order = np.concatenate(order)
        slots = np.arange(len(words)) + len(self._off) - 1
        self._off = np.concatenate([self._off, self._off[-1] + np.cumsum(lens[order])])
        self._ids = np.concatenate([self._ids, *flat_parts])
        keys, slots = np.concatenate([self._hash, hashes[order]]), np.concatenate([self._slot, slots])
        by_key = np.argsort(keys, kind="stable")
        self._hash, self._slot = keys[by_key], slots[by_key]

    @staticmethod
    def _units(raw: np.ndarray, offsets: np.ndarray):
        """Lowered bytes (words with '<' as they are: special tokens tell case
        apart), word ends and offsets, unit starts, ends, the last unit of each
        word, and running counts of bytes that are not letters."""
        starts, ends, at = tk.word_spans(raw, offsets)
        buf = tk.lowered(raw)
        for w in np.unique(np.searchsorted(starts, np.flatnonzero(raw == 60), side="right") - 1).tolist():
            buf[starts[w] : ends[w]] = raw[starts[w] : ends[w]]
        letter = _LETTER[buf]
        if len(buf) > 1:  # U+00C0 to U+00FF but for the two signs among them
            lead = buf[:-1] == 0xC3
            follow = lead & (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            letter[1:] |= follow
            letter[:-1] |= follow
        body = ends.copy()
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[_TRAIL[buf[body[todo] - 1]] & (body[todo] - starts[todo] > 1)]
            body[todo] -= 1
        body = np.where(letter[body - 1], body, ends) if len(body) else body
        two = body < ends
        last = np.cumsum(1 + two) - 1
        unit_start, unit_end = np.empty(len(starts) + int(two.sum()), dtype=np.int64), np.empty(len(starts) + int(two.sum()), dtype=np.int64)
        unit_start[last - two], unit_end[last - two] = starts, body
        unit_start[last[two]], unit_end[last[two]] = body[two], ends[two]
        odd = np.zeros(len(buf) + 1, dtype=np.int32)
        np.cumsum(~letter, out=odd[1:])
        return buf, ends, at, unit_start, unit_end, last, odd

    def _slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Where the ids of each span's text are kept; new texts are encoded."""
        hashes = tk.span_hashes(buf, starts, ends)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._hash) > CACHE_WORDS or len(self._ids) > CACHE_IDS:
            self._reset()
        pos = np.searchsorted(self._hash, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = pos < len(self._hash)
        known[inside] = self._hash[pos[inside]] == uniq[inside]
        if not known.all():
            new = first[~known]
            a, b, data = starts[new], ends[new], buf.tobytes()
            self._learn(uniq[~known], [data[i:j].decode() for i, j in zip(a.tolist(), b.tolist())], odd[a] == odd[b])
            pos = np.searchsorted(self._hash, uniq)
        return self._slot[pos][inverse] if len(uniq) else np.zeros(0, dtype=np.int64)

    def every_prefix(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without nulls: the tokens of each text's first 1, 2, ...
        bytes, n+1 offsets, and which of these prefixes end inside a character
        (their counts mean nothing). Different words are done once; the work on
        one grows with the square of its length."""
        if not self.by_word:
            raise ValueError("counts at every byte need a tokenizer that drops white space and marks word ends")
        raw, offsets = tk.buffers(texts)
        _, _, _, upto, at = self.encode(texts)
        buf, _, _, _, _, _, odd = self._units(raw, offsets)
        starts, stops, _ = tk.word_spans(raw, offsets)
        broken = np.zeros(len(raw), dtype=bool)
        broken[:-1] = (raw[1:] & 0xC0) == 0x80
        # Words that end at or before each prefix's end.
        done = np.cumsum(np.bincount(stops, minlength=len(raw) + 1))[1 : len(raw) + 1]
        some = done > np.repeat(at[:-1], np.diff(offsets))
        counts = np.zeros(len(raw), dtype=np.int64)
        counts[some] = upto[done[some] - 1]
        # Within a word its own prefix adds to them.
        _, first, same = np.unique(tk.span_hashes(buf, starts, stops), return_index=True, return_inverse=True)
        order = np.argsort(first)
        word, rank = first[order], np.argsort(order)[same]
        size = stops[word] - starts[word]
        table, table_at = np.zeros(int(size.sum()), dtype=np.int64), np.cumsum(size) - size
        owner = np.repeat(np.arange(len(word)), size)
        place = np.arange(len(table)) - table_at[owner]
        inner = (place + 1 < size[owner]) & ~broken[starts[word][owner] + place]
        owner, place = owner[inner], place[inner]
        heavy = np.concatenate([[0], np.cumsum(place + 1)])
        a = 0
        while a < len(place):
            b = max(int(np.searchsorted(heavy, heavy[a] + PREFIX_BYTES, side="right")) - 1, a + 1)
            begin = starts[word][owner[a:b]]
            slot = self._slots(buf, begin, begin + place[a:b] + 1, odd)
            table[table_at[owner[a:b]] + place[a:b]] = self._off[slot + 1] - self._off[slot]
            a = b
        lens = stops - starts
        which = np.repeat(np.arange(len(starts)), lens)
        step = np.arange(len(which)) - np.repeat(np.cumsum(lens) - lens, lens)
        counts[starts[which] + step] += table[table_at[rank[which]] + step]
        return counts, offsets, broken

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without nulls: ids, n+1 id offsets, end of every word in
        bytes of its text, tokens up to that end, and n+1 word offsets."""
        raw, offsets = tk.buffers(texts)
        if not self.by_word:
            ids = self._encode(texts.to_pylist())
            lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            off = np.concatenate([[0], np.cumsum(lens)])
            flat = np.fromiter((x for w in ids for x in w), dtype=np.uint32, count=int(off[-1]))
            return flat, off, np.diff(offsets), lens, np.arange(len(ids) + 1)
        buf, ends, at, unit_start, unit_end, last, odd = self._units(raw, offsets)
        slot = self._slots(buf, unit_start, unit_end, odd)
        begin, lens = self._off[slot], self._off[slot + 1] - self._off[slot]
        unit_upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self._ids[np.repeat(begin - unit_upto[:-1], lens) + np.arange(int(unit_upto[-1]))]
        upto = np.concatenate([[0], unit_upto[last + 1]])
        per_text = np.diff(at)
        return ids, upto[at], ends - np.repeat(offsets[:-1], per_text), upto[1:] - np.repeat(upto[at[:-1]], per_text), at
