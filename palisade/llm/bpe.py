"""Byte-level BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly those sequences that BPE makes. It starts as one state with every byte as an
arc. Each merge (u, v) -> w, in order, is a gadget: the state after u is replaced by a copy that lacks the arc v, so that u v
can no longer be read, and an arc w, which leads where v led after u, is added to every state that can read u and then v. A
copy is kept as its difference from the state that it copies: arcs removed at some step, on top of the older state. A state
therefore depends on the last token only, and looking up an arc walks the differences; what is found is kept in a table.

For encoding, each arc is spelled out in bytes, and the automaton is made deterministic over bytes by subsets: a state is the
set of arcs that are begun but not ended, each with the token before it. Every prefix of a word has one tokenization, so at most
one arc ends at each byte: that token is the state's output. A word is read left to right, a byte a step and never back; the
outputs, read from its end, are its tokens. The words of a piece of text take their steps together, by look-ups in tables that
are arrays; a long word takes them alone. Decoding emits the bytes on the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import chunks

#: How byte-level tokenizers split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Arcs that are kept, and words (in each of two generations): some 60 MB.
MOST_ARCS, MOST_WORDS = 400_000, 120_000
#: Words that step together, and the bytes beyond which a word steps alone.
TOGETHER, LONG = 20_000, 64


class Automaton:
    """Compiled merges. Tokens are ids; `labels` holds their bytes."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int]], special: dict[str, int]) -> None:
        self.labels, self.special = labels, special
        ids = {label: i for i, label in labels.items() if i not in special.values()}
        #: Merge step that made a token (-1: a byte), and what it is made of.
        self.born = {ids[bytes([b])]: -1 for b in range(256) if bytes([b]) in ids}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        #: Per token u: the arcs v that gadgets have removed from the state after u, with the step.
        self.removed: dict[int, dict[int, int]] = {}
        for step, (u, v) in enumerate(merges):
            if u not in self.born or v not in self.born or not self.reads(u, v):
                continue  # BPE can never see this pair
            w = ids[labels[u] + labels[v]]
            self.removed.setdefault(u, {})[v] = step
            if w not in self.born:
                self.born[w], self.left[w], self.right[w] = step, u, v
        #: The tokens spelled out as a prefix tree of bytes: sorted (node << 8 | byte) with the node after it; per node, the
        #: token that ends there (or -1) and whether it goes on. Per token, its bytes.
        step: dict[int, int] = {}
        token = [-1]
        for t in self.born:
            node = 0
            for b in labels[t]:
                after = step.setdefault(node << 8 | b, len(token))
                if after == len(token):
                    token.append(-1)
                node = after
            token[node] = t
        self.keys = np.array(sorted(step), np.int64)
        self.after = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.token = np.array(token, np.int64)
        self.inner = np.zeros(len(token), bool)
        self.inner[self.keys >> 8] = True
        self.size = np.zeros(max(labels) + 1, np.int64)
        self.size[list(self.born)] = [len(labels[t]) for t in self.born]
        self.clear()

    def clear(self) -> None:
        #: Arcs asked for: sorted (last token << 32 | token), and whether they are there.
        self.arcs, self.there = np.zeros(0, np.int64), np.zeros(0, bool)

    def reads(self, last: int, token: int) -> bool:
        """Whether the state after `last` has an arc `token`."""
        state, until = last, len(self.left) + 1 << 40  # `until`: the state is seen as it was at that step
        while True:
            removed = self.removed.get(state)
            if removed:
                t, after = token, 1 << 62
                while True:  # the arc `t` was there when `after`, its first use in a longer token, came
                    step = removed.get(t)
                    if step is not None and step < until and step <= after:  # equal: u u, read as u w
                        return False
                    if t not in self.left:
                        break
                    after, t = self.born[t], self.left[t]
            if state not in self.right:
                return True
            # A merged token's state began as the state after its right part, at that step.
            until, state = min(until, self.born[state]), self.right[state]

    def arcs_there(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """reads() of pairs; each is worked out once."""
        pair = last << 32 | token
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.arcs, pair), max(len(self.arcs) - 1, 0))
            known = self.arcs[place] == pair if len(self.arcs) else np.zeros(len(pair), bool)
            if known.all():
                return self.there[place] if len(pair) else known
            new = np.unique(pair[~known])
            if len(self.arcs) + len(new) > MOST_ARCS:
                self.clear()
                new = np.unique(pair)
            found = np.array([self.reads(x >> 32, x & 0xFFFFFFFF) for x in new.tolist()], bool)
            keys = np.concatenate([self.arcs, new])
            order = np.argsort(keys, kind="stable")
            self.arcs, self.there = keys[order], np.concatenate([self.there, found])[order]
        raise AssertionError("arcs are known by now")

    def words(self, many: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers; one byte of all words a step."""
        n = np.array([len(w) for w in many], np.int64)
        first = np.cumsum(n) - n
        data = np.frombuffer(b"".join(many), np.uint8).astype(np.int64)
        output = np.full(len(data), -1, np.int64)
        word, last, node = np.arange(len(many)), np.full(len(many), -1, np.int64), np.zeros(len(many), np.int64)
        for k in range(int(n.max(initial=0))):
            on = n[word] > k
            word, last, node = word[on], last[on], node[on]
            key = node << 8 | data[first[word] + k]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[place] == key
            word, last, node = word[on], last[on], self.after[place[on]]
            token = self.token[node]
            at = np.flatnonzero(token >= 0)
            asked = at[last[at] >= 0]
            ends = np.concatenate([at[last[at] < 0], asked[self.arcs_there(last[asked], token[asked])]])
            output[first[word[ends]] + k] = token[ends]
            on = self.inner[node]
            word, last, node = np.concatenate([word[on], word[ends]]), np.concatenate([last[on], token[ends]]), np.concatenate([node[on], np.zeros(len(ends), np.int64)])
        # The outputs from each word's end on.
        word, left, parts = np.flatnonzero(n), n[n > 0], []
        while len(word):
            t = output[first[word] + left - 1]
            if (t < 0).any():
                raise ValueError(f"no token sequence for {many[word[np.argmin(t)]]!r}: the vocabulary lacks a byte")
            parts.append((word, t))
            left = left - self.size[t]
            word, left = word[left > 0], left[left > 0]
        if not parts:
            return [b""] * len(many)
        owner, found = np.concatenate([w for w, _ in parts[::-1]]), np.concatenate([t for _, t in parts[::-1]])
        order = np.argsort(owner, kind="stable")
        packed, ends = found[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(owner, minlength=len(many)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def word(self, data: bytes) -> bytes:
        """The ids of one word, as words() gives them, in time that follows its length."""
        step = dict(zip(self.keys.tolist(), self.after.tolist(), strict=True)) if not hasattr(self, "steps") else self.steps
        self.steps = step
        begun, output, there = [(-1, 0)], [], {}
        for byte in data:
            now, ended = [], -1
            for last, node in begun:
                after = step.get(node << 8 | byte)
                if after is None:
                    continue
                if self.inner[after]:
                    now.append((last, after))
                t = int(self.token[after])
                if t >= 0 and ended < 0:  # no other arc ends where one does
                    ok = last < 0 or there.get((last, t))
                    if ok is None:
                        ok = there[last, t] = self.reads(last, t)
                    if ok:
                        ended = t
            if ended >= 0:
                now.append((ended, 0))
            begun = now
            output.append(ended)
        out, at = [], len(data)
        while at:
            if output[at - 1] < 0:
                raise ValueError(f"no token sequence for {data!r}: the vocabulary lacks a byte")
            out.append(output[at - 1])
            at -= int(self.size[out[-1]])
        return np.array(out[::-1], "<u4").tobytes()


def compile_merges(tokenizer_json: str) -> Automaton:
    """From the text of a tokenizer file of the byte-level BPE kind."""
    spec = json.loads(tokenizer_json)
    symbol = byte_symbols()
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    as_bytes = lambda s: bytes(symbol[c] for c in s)
    vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
    labels = {i: as_bytes(s) for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return Automaton(labels, [(vocab[u], vocab[v]) for u, v in pairs], special)


#: Letters and numbers below this point are listed one by one for a faster splitter; texts with others take the general one.
LISTED = 0x250


def listed_pattern() -> re.Pattern[str]:
    """PATTERN for texts whose characters all lie below LISTED."""
    of = lambda kind: "".join(re.escape(chr(k)) for k in range(LISTED) if unicodedata.category(chr(k))[0] == kind)
    letters, numbers, spaces = of("L"), of("N"), r"\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


#: Stands before a special token's string; the splitter never leaves both characters in one word.
MARK = "\0a"


class Codec:
    """Encodes texts and decodes ids. Words met lately keep their ids, in two generations of `most` words: when the younger is
    full it becomes the older one, and what the older one held is forgotten."""

    def __init__(self, automaton: Automaton, most: int = MOST_WORDS) -> None:
        self.automaton, self.most = automaton, most
        self.general, self.listed = regex.compile(PATTERN), listed_pattern()
        self.is_listed = re.compile(f"[\x00-{chr(LISTED - 1)}]*").fullmatch
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(automaton.special, key=len, reverse=True))) if automaton.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.label = [automaton.labels.get(i, b"") for i in range(max(automaton.labels) + 1)]
        self.marks = {MARK + s: i.to_bytes(4, "little") for s, i in automaton.special.items()}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't among the younger known ones; short ones are kept."""
        out, new = dict(self.marks), []
        for w in words:
            ids = self.older.get(w)
            if ids is not None:
                out[w] = ids
            elif w in out:
                continue
            elif len(w) < LONG:
                new.append(w)
            else:
                out[w] = self.automaton.word(w.encode())
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            out.update(zip(part, self.automaton.words([w.encode() for w in part]), strict=True))
        if len(self.known) + len(out) > self.most:
            self.known, self.older = {}, self.known
        if len(out) <= self.most:
            self.known.update({w: ids for w, ids in out.items() if len(w) < LONG})
        return out

    def split(self, text: str) -> list[str]:
        return (self.listed if self.is_listed(text) else self.general).findall(text)

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers. Special tokens' strings are taken as those tokens."""
        get, rows, missing = self.known.get, [], {}
        for text in texts:
            words, at = [], 0
            for m in self.special.finditer(text) if self.special is not None else ():
                words += [*self.split(text[at : m.start()]), MARK + m.group()]
                at = m.end()
            words += self.split(text[at:] if at else text)
            found = list(map(get, words))
            gaps = [k for k, x in enumerate(found) if x is None] if None in found else []
            missing.update((words[k], None) for k in gaps)
            rows.append((found, [(k, words[k]) for k in gaps]))
        new = self.learn(list(missing)) if missing else {}
        for found, gaps in rows:
            for k, w in gaps:
                found[k] = new[w]
        return [b"".join(found) for found, _ in rows]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes: the labels of the arcs; what isn't UTF-8 is replaced as the library does."""
        data = b"".join(map(self.label.__getitem__, memoryview(ids).cast("I")))
        return data.decode("utf-8", "replace").encode()


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(texts: Iterable[str | None], codec: Codec) -> list[tuple[bytes, bytes]]:
    return [(ids, codec.decode(ids)) for ids in codec.encode_all(t or "" for t in texts)]


def _run(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    automaton = docs.sparkSession.sparkContext.broadcast(compile_merges(tokenizer_json))  # bounded by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(automaton.value)
        for batch in chunks(batches, "text"):
            found = encoded(batch.column(1).to_pylist(), codec)
            n = pa.array([len(i) // 4 for i, _ in found], pa.int64())
            if digests:
                a = pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string())
                b = pa.array([hashlib.sha256(t).hexdigest() for _, t in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, a, b], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([i for i, _ in found], pa.binary()), pa.array([t.decode() for _, t in found], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    return rows.mapInArrow(encode, DIGESTS if digests else SCHEMA)


def tokenise(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), decoded: one row for each of docs, in one pass, no shuffle.

    Null and empty texts have no tokens and decode to the empty text. Very long texts are read whole; memory follows the
    longest text. Repeated rows each give a row. No rows give no rows. Other columns are ignored.
    """
    return _run(docs, tokenizer_json, id_col, text_col, False)


def token_digests(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As tokenise, with the SHA-256 of ids and decoded text in their place."""
    return _run(docs, tokenizer_json, id_col, text_col, True)


def tokenizer_file(path: str | None = None) -> str:
    """The text of a tokenizer file; the public byte-level one by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
