"""Token counts by a byte-level transducer compiled from a BPE vocabulary (operator 7).

The vocabulary's merges are compiled to a deterministic transducer over bytes. Reading a byte moves
to a state and emits by how much the number of tokens of the text so far changes, so the sum of
what is emitted is the number of tokens. States are made when first reached and numbered in a dense
table; the table starts anew when it outgrows its bound. Chunks of a text are maps from state to
state, held for the states that reach them, and compose by a parallel prefix scan.

A state holds the bytes that a later token may still cover, and for each place in them where such a
token could begin: the token that ends there and the number of tokens up to there, relative to now.
Of a text's prefix, only one token can be the last: the one that begins at such a place and stays
apart from the token that ends there.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dramaturg.llm._shared import sub_batches, table, with_computed

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Fixed value: what may follow an apostrophe as a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_EMIT_BITS, _EMIT_ZERO = 7, 64
_UNKNOWN = np.int32(-1)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_classes(tokenizer_json: str) -> np.ndarray:
    """Letter, number, white space or other, for every code point, as the library sees them.

    Code points that this Python doesn't know yet are asked of the library itself.
    """
    import regex
    from tokenizers import Tokenizer

    out = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            out[cp] = LETTER
        elif kind[0] == "N":
            out[cp] = NUMBER
        elif kind == "Cn":
            unknown.append(chr(cp))
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for c in regex.findall(r"\s", every):
        out[ord(c)] = SPACE
    split = Tokenizer.from_str(tokenizer_json).pre_tokenizer.pre_tokenize_str
    for c in regex.findall(r"[\p{L}\p{N}]", "".join(unknown)):
        if len(split(f"a{c}a")) == 1:
            out[ord(c)] = LETTER
        elif len(split(f"1{c}1")) == 1:
            out[ord(c)] = NUMBER
    return out


def piece_starts(cps: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start, of texts laid end to end; ``begins`` marks each text's first character.

    Pieces are: an apostrophe with one of the contractions; a run of letters, of numbers or of
    other characters, with one space before it if there is one; white space. Of white space before
    something else the last character is apart, so that a space can join what follows.
    """
    n = cps.size
    starts = begins.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    ends = np.ones(n, bool)
    ends[:-1] = begins[1:]
    # the last white space before something else, in the same text
    last = space & ~ends
    last[:-1] &= ~space[1:]
    starts |= last
    joins = last & (cps == 32)
    at = np.flatnonzero(joins)
    starts[at + 1] = False
    # contractions: an apostrophe that starts a piece, with the letters that follow in the same text
    for i in np.flatnonzero((cps == 39) & starts):
        if i + 1 < n and not begins[i + 1]:
            for c in CONTRACTIONS:
                j = i + 1 + len(c)
                if j <= n and not begins[i + 1: j].any() and all(cps[i + 1 + k] == ord(x) for k, x in enumerate(c)):
                    starts[i + 1: j] = False
                    if j < n:
                        starts[j] = True
                    break
    return starts


class Transducer:
    """The lazily compiled automaton of one vocabulary; see the module's text."""

    def __init__(self, spec: dict, most_states: int = 200_000):
        letters = byte_letters()
        tokens = {bytes(letters[c] for c in t): i for t, i in spec["vocab"].items() if all(c in letters for c in t)}
        self.split: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        by_text = spec["vocab"]
        for rank, (a, b) in enumerate(spec["merges"]):
            one, two, both = by_text[a], by_text[b], by_text[a + b]
            self.merge[one, two] = rank
            if both not in self.split:
                self.split[both], self.rank[both] = (one, two), rank
        # tokens that no merge makes, of more than one byte, never come out
        self.tokens = {t: i for t, i in tokens.items() if len(t) == 1 or i in self.split}
        self.longer: dict[bytes, list[int]] = {}
        for t, i in self.tokens.items():
            for n in range(len(t)):
                self.longer.setdefault(t[:n], []).append(i)
        self._forget()
        self.most_states = most_states
        self._restart()

    def _forget(self) -> None:
        self._same: dict[tuple[bytes, int], int] = {}
        self._first: dict[tuple[bytes, tuple], int] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def _restart(self) -> None:
        self.keys: list[tuple] = [(b"", ((0, -1, 0),))]
        self.number = {self.keys[0]: 0}
        self.column = getattr(self, "column", np.full(256, -1, np.int32))
        self.bytes = getattr(self, "bytes", [])
        self.width = getattr(self, "width", 64)
        self.table = np.full(1024 * self.width, _UNKNOWN, np.int32)

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two tokens.

        Undo merges on both sides of the seam, the latest first. They would have met if, at some
        moment, the pieces at the seam have a merge that comes before the one undone next.
        """
        got = self._apart.get((left, right))
        if got is None:
            got = self._apart[left, right] = self._stay(left, right)
        return got

    def _stay(self, left: int, right: int) -> bool:
        # pieces at the seam, each with the rank of the merge that takes it into a larger piece
        a, a_until = left, float("inf")
        b, b_until = right, float("inf")
        while True:
            meet = self.merge.get((a, b))
            # of equal ranks the leftmost is merged first, so the pair loses a tie only on its left
            if meet is not None and meet < a_until and meet <= b_until:
                return False
            a_made, b_made = self.rank.get(a, -1), self.rank.get(b, -1)
            if a_made < 0 and b_made < 0:
                return True
            if a_made > b_made:
                a_until, a = a_made, self.split[a][1]
            else:
                b_until, b = b_made, self.split[b][0]

    def _step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        suffix, places = state
        suffix += bytes((byte,))
        for place, token, count in places:
            t = self.tokens.get(suffix[place:])
            if t is not None and (token < 0 or self.apart(token, t)):
                now = count + 1
                break
        else:
            raise ValueError(f"no token ends here: {suffix!r}")
        kept = []
        for p, k, c in places:
            k = self._as(suffix[p:], k)
            if k is not None:
                kept.append((p, k, c - now))
        first = kept[0][0] if kept else len(suffix)
        return (suffix[first:], (*((p - first, k, c) for p, k, c in kept), (len(suffix) - first, t, 0))), now

    def _as(self, begun: bytes, token: int, few: int = 6) -> int | None:
        """A token that acts as ``token`` does before those that begin with ``begun``.

        None if no token can begin there. Tokens before the same few continuations are told apart
        only by which of them they let stand; this merges most states that differ in what is past.
        """
        longer = self.longer.get(begun)
        if longer is None:
            return None
        if token < 0 or len(longer) > few:
            return token
        got = self._same.get((begun, token), -2)
        if got == -2:
            stands = tuple(t for t in longer if self.apart(token, t))
            got = self._same[begun, token] = self._first.setdefault((begun, stands), token) if stands else None
        return got

    def _grow(self, wanted: np.ndarray) -> None:
        """Give bytes that appear for the first time a column of the table."""
        new = [b for b in wanted.tolist() if self.column[b] < 0]
        if not new:
            return
        if len(self.bytes) + len(new) > self.width:
            rows, old = self.table.reshape(-1, self.width), self.width
            while len(self.bytes) + len(new) > self.width:
                self.width *= 2
            wide = np.full((rows.shape[0], self.width), _UNKNOWN, np.int32)
            wide[:, :old] = rows
            self.table = wide.reshape(-1)
        for b in new:
            self.column[b] = len(self.bytes)
            self.bytes.append(b)

    def _compile(self, cells: np.ndarray) -> None:
        for cell in np.unique(cells).tolist():
            state, column = divmod(cell, self.width)
            key, emit = self._step(self.keys[state], self.bytes[column])
            number = self.number.get(key)
            if number is None:
                number = self.number[key] = len(self.keys)
                self.keys.append(key)
                self._room(number)
            self.table[cell] = (number << _EMIT_BITS) | (emit + _EMIT_ZERO)

    def _room(self, number: int) -> None:
        if number * self.width >= self.table.size:
            more = np.full(max(1024, number // 4) * self.width, _UNKNOWN, np.int32)
            self.table = np.concatenate([self.table, more])

    def step(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and what is emitted, for many independent readers."""
        cells = states * self.width + columns
        moved = self.table[cells]
        missing = moved < 0
        if missing.any():
            self._compile(cells[missing])
            moved = self.table[cells]
        return moved >> _EMIT_BITS, (moved & (2 * _EMIT_ZERO - 1)) - _EMIT_ZERO

    def emitted(self, data: np.ndarray, starts: np.ndarray, lanes: int = 4096, block: int = 1 << 19) -> np.ndarray:
        """What is emitted at each byte; the state is the first one again where a piece starts.

        Blocks of bytes are read one after the other, so that the tables can start anew between
        them; see :meth:`_read` for what happens inside one.
        """
        self._grow(np.flatnonzero(np.bincount(data, minlength=256)))
        out, key = np.empty(data.size, np.int8), self.keys[0]
        for at in range(0, data.size, block):
            if len(self.keys) > self.most_states:
                self._restart()
            if len(self._apart) + len(self._same) + len(self._first) > 8 * self.most_states:
                self._forget()
            part = slice(at, at + block)
            out[part], last = self._read(data[part], starts[part], self._number(key), lanes)
            key = self.keys[last]
        return out

    def _number(self, key: tuple) -> int:
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.keys)
            self.keys.append(key)
            self._room(number)
        return number

    def _read(self, data: np.ndarray, starts: np.ndarray, first: int, lanes: int, most_rounds: int = 48) -> tuple[np.ndarray, int]:
        """Emissions at each byte and the state at the end, from the state ``first``.

        The bytes are cut into chunks that are read side by side, each from a guessed state. What a
        chunk does is a map from the state before it to the state after it; a chunk in which a piece
        starts maps every state to the same one. Maps are composed over all chunks by a parallel
        prefix scan. Chunks whose true state before isn't in their map yet (or isn't known yet: then
        a state after the chunk before) are read again from it, all at once, until the scan knows
        the state before every chunk. A chunk is read again only as far as its states differ from
        those read before, mostly a few bytes. Maps hold at most ``most_rounds`` states; what isn't
        known by then is read from left to right.
        """
        lanes = int(max(1, min(lanes, data.size // 64)))
        length = -(-data.size // lanes)
        pad = lanes * length - data.size
        columns = np.concatenate([self.column[data], np.full(pad, self.column[data[0]], np.int32)]).reshape(lanes, length)
        fresh = np.concatenate([starts, np.ones(pad, bool)]).reshape(lanes, length)
        constant = fresh.any(axis=1)
        head = np.where(constant, fresh.argmax(axis=1), length)
        by_step, going = np.ascontiguousarray(columns.T), np.ascontiguousarray(~fresh.T)
        out, path = np.zeros((length, lanes), np.int8), np.empty((length, lanes), np.int32)
        states = np.zeros(lanes, np.int64)
        states[0] = first
        entries, current = [states.copy()], states.copy()
        for j in range(length):
            states = states * going[j]
            states, out[j] = self.step(states, by_step[j])
            path[j] = states
        exits = [states.copy()]

        def again(lane: np.ndarray, state: np.ndarray) -> None:
            """Read the heads of these chunks from other states, until they meet what was read before."""
            current[lane] = state
            for j in range(int(head[lane].max())):
                more = head[lane] > j
                lane, state = lane[more], state[more]
                state, out[j, lane] = self.step(state, by_step[j, lane])
                apart = path[j, lane] != state
                path[j, lane] = state
                lane, state = lane[apart], state[apart]
                if not lane.size:
                    break

        while True:
            known, made = np.array(entries), np.array(exits)
            before = np.concatenate([[first], _composed(known, made, constant)[:-1]])
            # states after the chunk before, of which this one's map doesn't tell yet
            prior = np.concatenate([np.full((len(made), 1), first), made[:, :-1]], axis=1)
            untold = ~(prior[:, None] == known[None]).any(axis=1)
            sure = (before >= 0) & ~(known == before).any(axis=0)
            wanted = np.where(sure, before, prior[untold.argmax(axis=0), np.arange(lanes)])
            new = (head > 0) & (sure | ((before < 0) & untold.any(axis=0)))
            # chunks with nothing to read try states that often come after others: periodic texts have few
            states, often = np.unique(made, return_counts=True)
            pool = states[np.argsort(-often)[:32]]
            untried = ~(pool[:, None, None] == known[None]).any(axis=1)
            idle = (head > 0) & (before < 0) & ~new & untried.any(axis=0)
            wanted = np.where(idle, pool[untried.argmax(axis=0)], wanted)
            new |= idle
            # the leftmost chunk that isn't told by the scan follows one that can be read now
            if not new.any():
                break
            if len(entries) > most_rounds:  # maps of too many states: the rest is read from left to right
                state = first
                for i in range(lanes):
                    before[i] = state
                    if head[i] and current[i] != state:
                        again(np.array([i]), np.array([state]))
                    state = int(path[length - 1, i])
                break
            lane, entry, exit_ = np.flatnonzero(new), entries[-1].copy(), exits[-1].copy()
            again(lane, wanted[lane].astype(np.int64))
            entry[lane], exit_[lane] = wanted[lane], path[length - 1, lane]
            entries.append(entry)
            exits.append(exit_)
        lane = np.flatnonzero((head > 0) & (current != before))
        if lane.size:
            again(lane, before[lane].astype(np.int64))
        lane, j = divmod(data.size - 1, length)
        return out.T.reshape(-1)[: data.size], int(path[j, lane])


def _composed(entries: np.ndarray, exits: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """The state after each chunk, by a prefix scan over chunk maps; -1 where the maps don't tell.

    Map i sends ``entries[:, i]`` to ``exits[:, i]``, or everything to one state if ``constant[i]``.
    In the first map ``entries[0]`` is the state before all chunks.
    """
    n = constant.size
    domain, image, constant = entries.copy(), exits.astype(np.int64), constant.copy()
    image[:, constant] = image[-1, constant]

    def looked_up(state: np.ndarray, right: np.ndarray) -> np.ndarray:
        hit = domain[:, right] == state
        found = np.take_along_axis(image[:, right], hit.argmax(axis=0)[None], axis=0)[0]
        return np.where(hit.any(axis=0) & (state >= 0), found, -1)

    stride = 1
    while stride < n:
        right = np.arange(stride, n)
        left = right - stride
        made = np.stack([looked_up(image[k, left], right) for k in range(len(image))])
        made = np.where(constant[right], image[:, right], made)
        new_domain = domain[:, left]
        constant = np.concatenate([constant[:stride], constant[right] | constant[left]])
        domain = np.concatenate([domain[:, :stride], new_domain], axis=1)
        image = np.concatenate([image[:, :stride], made], axis=1)
        stride *= 2
    return image[0]


class Counter:
    """Counts the tokens of texts: special strings, then pieces, then the transducer."""

    def __init__(self, tokenizer_json: str, classes: np.ndarray):
        spec = json.loads(tokenizer_json)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without a normaliser is compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.transducer, self.classes = Transducer({"vocab": model["vocab"], "merges": pairs}), classes

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of every text."""
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        segments, owners = [], []
        for i, text in enumerate(texts):
            parts = [text or ""]
            for special in self.special:
                parts = [x for part in parts for x in part.split(special)]
            n_tokens[i] = len(parts) - 1
            for part in parts:
                if part:
                    segments.append(part)
                    owners.append(i)
            n_bytes[i] = len((text or "").encode("utf-8", "surrogatepass"))
        for a, b in sub_batches([len(s) for s in segments], 2 << 20):
            np.add.at(n_tokens, owners[a:b], self._count(segments[a:b]))
        return n_bytes, n_tokens

    def _count(self, segments: list[str]) -> np.ndarray:
        joined = "".join(segments)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(s) for s in segments])
        begins = np.zeros(cps.size, bool)
        first = np.cumsum(lengths) - lengths
        begins[first] = True
        starts = piece_starts(cps, self.classes[cps], begins)
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        at = np.cumsum(width) - width
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        flags = np.zeros(data.size, bool)
        flags[at[starts]] = True
        return np.add.reduceat(self.transducer.emitted(data, flags), at[first], dtype=np.int64)


_COUNTERS: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_bytes`` and ``_n_tokens`` of the whole text.

    The vocabulary file's content is broadcast (two megabytes); each Python worker compiles its
    automaton as texts need it and keeps it, within a bound, for later batches.

    Defined results: null and empty texts have 0 bytes and 0 tokens; special strings in a text are
    one token each; other columns and repeated rows pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, char_classes(tokenizer_json)))

    def compute(texts):
        counter = _COUNTERS.get(hash(shared.value[0]))
        if counter is None:
            counter = _COUNTERS[hash(shared.value[0])] = Counter(*shared.value)
        return counter.counts(texts)

    return with_computed(docs, text_col, "_n_bytes bigint, _n_tokens bigint", compute)


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None, limit: int = 1024) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_json).select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n_tokens").alias("n_tokens"),
        (F.col("_n_tokens") > limit).alias("over_limit"),
    )
