"""Byte-pair encoding of one piece of bytes: merge tables, pair validity, prefix counts and the tree reduction.

A sequence of tokens is what the merges give for its bytes exactly if each two neighbours are: that is, if merging
the bytes of the two alone gives the two again. Prefix counts and joins of halves both rest on that.
"""

from __future__ import annotations

import base64
import itertools
import json
from collections.abc import Iterable, Iterator

NO_RANK = 1 << 60
#: Entries of a memo; it is emptied when full, so a worker's memory doesn't grow with its input.
MEMO_ENTRIES = 400_000
#: Leaves of the tree: so many bytes are merged directly; longer pieces are halved.
LEAF_BYTES = 16
#: Tokens that are concatenated in a leaf when decoding.
LEAF_TOKENS = 64


class Merges:
    """Merges by rank of the joined bytes (rank files) or by listed pair (json files)."""

    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int] | None = None):
        self.ids = ids
        self.pairs = pairs
        self.longest = max(map(len, ids))
        self.packed = {token: i.to_bytes(4, "little") for token, i in ids.items()}
        self.valid_memo: dict[tuple[bytes, bytes], bool] = {}
        self.beside_memo: dict[int, bool] = {}
        self.token = {i: token for token, i in ids.items()}
        self.rank, self.left, self.right = self.splits()

    def splits(self) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
        """Of each token of a listed pair the pair's rank and its two ids, if no token is listed twice; else nothing."""
        pairs, ids = self.pairs or {}, self.ids
        if not pairs or len({a + b for a, b in pairs}) < len(pairs) or not all(a in ids and b in ids and a + b in ids for a, b in pairs):
            return {}, {}, {}
        rank, left, right = {ids[a + b]: i for (a, b), i in pairs.items()}, {}, {}
        for a, b in pairs:
            left[ids[a + b]], right[ids[a + b]] = ids[a], ids[b]
        return rank, left, right

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a piece, by repeated merging of the leftmost pair of lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ids, pairs = self.ids, self.pairs
        if pairs is None:
            ranks = [ids.get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        else:
            ranks = [pairs.get((parts[i], parts[i + 1]), NO_RANK) for i in range(len(piece) - 1)]
        while ranks:
            lowest = min(ranks)
            if lowest == NO_RANK:
                break
            i = ranks.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = ids.get(parts[i - 1] + parts[i], NO_RANK) if pairs is None else pairs.get((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = ids.get(parts[i] + parts[i + 1], NO_RANK) if pairs is None else pairs.get((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def valid(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay two tokens when their joined bytes are encoded; with no a, whether b is its own encoding."""
        found = self.valid_memo.get((a, b))
        if found is None:
            if len(self.valid_memo) >= MEMO_ENTRIES:
                self.valid_memo.clear()
            found = self.valid_memo[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def beside(self, a: int, b: int) -> bool:
        """valid() of two ids, a being its own encoding or -1 for none.

        Where each token has one pair, the merges of both are taken back from the latest on: whenever the two tokens at the
        boundary have a merge of their own that comes before the one taken back last, it would have joined them.
        Of equal ranks the left merge comes first.
        """
        token = self.token
        if a < 0 or not self.rank:
            return self.valid(token[a] if a >= 0 else b"", token[b])
        if not self.valid(b"", token[b]):
            return False
        rank, pairs, limit = self.rank, self.pairs, NO_RANK
        while pairs.get((token[a], token[b]), NO_RANK) >= limit:
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True
        return False

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token counts of each prefix of the piece, from 0 bytes to all of it."""
        return next(self.prefix_table([piece]))[:]

    def prefix_table(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """For each piece the token counts of its prefixes, by dynamic programming; the list is used again for the next.

        The last token of a prefix is the one token that ends there and is valid after the last token of what
        precedes it; its count is one more than that of the prefix before it. What a piece has in common with the
        start of the one before it isn't worked out again, so sorted pieces cost least.
        """
        longest, get, memo = self.longest, self.ids.get, self.beside_memo
        counts, last, begin, before = [0], [-1], [0], b""
        for piece in pieces:
            n, same = len(piece), 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :], begin[same + 1 :]
            for end in range(same + 1, n + 1):
                # the token before with one byte more is tried first
                for start in itertools.chain((begin[-1],), range(end - longest if end > longest else 0, end)):
                    token = get(piece[start:end])
                    if token is not None:
                        key = last[start] << 32 | token
                        good = memo.get(key)
                        if good is None:
                            if len(memo) >= MEMO_ENTRIES:
                                memo.clear()
                            good = memo[key] = self.beside(last[start], token)
                        if good:
                            counts.append(counts[start] + 1)
                            last.append(token)
                            begin.append(start)
                            break
            before = piece
            yield counts

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The tokens of the joined bytes of two encoded sides.

        A window at the boundary, of one token of each side at first, is encoded again and doubled until it is valid
        beside the tokens left out; then those provably stay as they are.
        """
        if not left or not right:
            return left or right
        if self.valid(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(left[a:] + right[:b]))
            if (not a or self.valid(left[a - 1], window[0])) and (b == len(right) or self.valid(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def tree(self, piece: bytes) -> list[bytes]:
        """The tokens of a piece: halves are encoded by themselves and joined, level by level."""
        level = [self.merge(piece[i : i + LEAF_BYTES]) for i in range(0, len(piece), LEAF_BYTES)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []


def load_ranks(path: str) -> Merges:
    """A .tiktoken file: base64 of a token's bytes and its rank in each line."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in json vocabularies: printable bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def refuse(spec: dict, path: str) -> None:
    """Raise for a vocabulary whose counts these merges wouldn't give."""
    model, before = spec["model"], spec.get("pre_tokenizer")
    steps = before["pretokenizers"] if before and before["type"] == "Sequence" else [before or {"type": "none"}]
    kinds = [(s["type"], bool(s.get("use_regex", True)), bool(s.get("add_prefix_space", False))) for s in steps]
    plain = kinds == [("ByteLevel", True, False)] or [k[0] for k in kinds] == ["Split", "ByteLevel"] and not kinds[1][1] and not kinds[1][2]
    odd = [name for name, bad in {
        "a normalizer": spec.get("normalizer"), "a pre-tokenizer other than the byte-level one": not plain, "a model other than BPE": model.get("type", "BPE") != "BPE",
        "dropout": model.get("dropout"), "an affix of words": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"), "ignored merges": model.get("ignore_merges"),
        "added tokens that strip, stand alone or are normalised": any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")),
    }.items() if bad]
    if odd:
        raise ValueError(f"{path} has {', '.join(odd)}")


def load_json(path: str) -> tuple[Merges, list[str]]:
    """A tokenizers .json file of a byte-level BPE: its merges and its added tokens' strings. What would count otherwise is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    refuse(spec, path)
    letters = byte_letters()
    as_bytes = lambda s: bytes(letters[c] for c in s)
    added = [x["content"] for x in spec["added_tokens"]]
    ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    split = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    pairs = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(split)}
    return Merges(ids, pairs), added
