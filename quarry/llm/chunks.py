"""Token ids of whole texts: chunks between white space are told apart by Arrow, each distinct one is encoded once."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space; no token of either tokenizer reaches over it, but for one leading space of the byte kind.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BYTE_CHUNK = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
#: Texts that a split at single spaces and line ends would cut otherwise than BYTE_CHUNK does.
BYTE_SLOW = "[\\x1f\\x0b\\x0c\\r\\t\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|[ \\n]$"
CUT = "\x1f"
WORD_END = "</w>"
#: Strings that stay apart from their neighbours in either kind; a chunk that is made up of them needs no other look.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
WORD_PIECE = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+")
BYTE_PIECE = re.compile(f" ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+")
#: Marks after a letter and before white space: always apart from the letter.
ENDING = f"([{LETTERS}])([{MARKS}]+)([ \\n]|$)"
#: Longer pieces are encoded on their own and not kept.
LONG = 48

_open: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Encodes texts by a tokenizer file of the tokenizers library, without special tokens.

    Special tokens' strings within a text are ordinary text. Ids of distinct chunks are kept for later texts in two
    generations of room / 2 each: what is met again moves to the younger, and the older one goes when that is full, so
    frequent chunks stay. Texts are never cut short, and a chunk without white space is encoded as a whole.
    """

    def __init__(self, path: str, kind: str, room: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind, self.room, self.known, self.older = kind, room, {}, {}
        vocab = self.tokenizer.get_vocab()
        # an id after which a joined text is cut: the end of a word, or the line feed that stands between pieces
        self.cuts = np.zeros(max(vocab.values()) + 1, bool)
        self.cuts[[i for token, i in vocab.items() if (token.endswith(WORD_END) if kind == "word" else token == "Ċ")]] = True
        self.piece, self.glue = (WORD_PIECE, " ") if kind == "word" else (BYTE_PIECE, "\n")

    def chunks(self, texts: pa.Array) -> pa.Array:
        """A list of chunks for each text."""
        if self.kind == "word":
            plain = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
            return pc.split_pattern(pc.replace_substring_regex(plain, ENDING, "\\1 \\2\\3"), " ")
        slow = pc.match_substring_regex(texts, BYTE_SLOW)
        plain = pc.replace_substring_regex(pc.if_else(slow, "", texts), ENDING, f"\\1{CUT}\\2\\3")
        fast = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, "\n", f"{CUT}\n{CUT}"), " ", f"{CUT} "), CUT)
        if not pc.any(slow).as_py():
            return fast
        own = pa.array([BYTE_CHUNK.findall(t.as_py()) if s.as_py() else None for t, s in zip(texts, slow)], pa.list_(pa.large_string()))
        return pc.if_else(slow, own, fast)

    def alone(self, new: list[str]) -> None:
        """Encode chunks one by one."""
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[chunk] = np.asarray(e.ids, dtype="<u4").tobytes()

    def together(self, pieces: list[str], many: int = 512) -> None:
        """Encode pieces many at a time, as one text that is cut between them."""
        other, keep_glue = [p for p in pieces if len(p) > LONG], self.kind == "word"
        pieces = [p for p in pieces if len(p) <= LONG]
        parts = [pieces[i : i + many] for i in range(0, len(pieces), many)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.glue.join(p) for p in parts], add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            stops = np.flatnonzero(self.cuts[ids])
            # no piece has less than one end (word) or a line feed (byte): equal counts mean that each cut is right
            if len(stops) != len(part) - (not keep_glue):
                other += part
                continue
            ends = (stops + 1).tolist() if keep_glue else [*stops.tolist(), len(ids)]
            data, a = ids.tobytes(), 0
            for piece, b in zip(part, ends):
                self.known[piece] = data[4 * a : 4 * b]
                a = b + (not keep_glue)
        self.alone(other)

    def learn(self, new: list[str]) -> None:
        """Encode chunks: those that are made up of pieces by their pieces, the others one by one."""
        known, older, lower = self.known, self.older, self.kind == "word"
        one, find = self.piece.fullmatch, self.piece.findall
        other, made, pieces = [], [], {}
        for chunk in new:
            if one(chunk) and (not lower or chunk.islower()):
                pieces[chunk] = None
                continue
            parts = find(chunk)
            if "".join(parts) != chunk:
                other.append(chunk)
                continue
            if lower:
                parts = [p.lower() for p in parts]
            made.append((chunk, parts))
            for p in parts:
                if p not in known:
                    if (ids := older.get(p)) is None:
                        pieces[p] = None
                    else:
                        known[p] = ids
        self.together(list(pieces))
        self.alone(other)
        for chunk, parts in made:
            known[chunk] = b"".join([known[p] for p in parts])
        for chunk in [*pieces, *new]:
            if len(chunk) > LONG:
                self.large.append(chunk)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i] : offsets[i + 1]]; a null text has none."""
        lists = self.chunks(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = lists.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if len(self.known) > self.room // 2:
            self.known, self.older = {}, self.known
        known, older, new, self.large = self.known, self.older, [], []
        for c in distinct:
            if c not in known:
                if (ids := older.get(c)) is None:
                    new.append(c)
                else:
                    known[c] = ids
        self.learn(new)
        each = [known[c] for c in distinct]
        for chunk in self.large:
            known.pop(chunk, None)
        starts = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in each], out=starts[1:])
        table = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(each), "<u4")))
        index = flat.indices.to_numpy(zero_copy_only=False)
        ids = table.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False) if len(index) else np.zeros(0, "<u4")
        upto = np.zeros(len(index) + 1, np.int64)
        np.cumsum(np.diff(starts)[index], out=upto[1:])
        at = lists.offsets.to_numpy(zero_copy_only=False)
        return upto[at - at[0]], ids


def encoder(name: str, kind: str, room: int = 1_200_000) -> Encoder:
    """The worker's encoder for a file of the public tokenizers, or for a path; room: chunks whose ids it keeps."""
    if (name, kind) not in _open:
        import public_tokenizers

        _open[name, kind] = Encoder(name if "/" in name else public_tokenizers.path(name), kind, room)
    return _open[name, kind]


def slices(texts: pa.Array, most: int = 8_000_000):
    """(start, stop) of runs of texts of about so many bytes, so that long texts do not pile up."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield start, stop
        start = stop
