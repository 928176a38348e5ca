"""Language-model scores of texts: a hierarchical Pitman-Yor model of word pairs.

Texts (null: empty) are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and closed by one
end token. The restaurant of a context (the word before, or the start) serves the words that follow it
in training texts; all contexts share the root restaurant as parent, and its parent is uniform over the
V training tokens and one for all others. With c customers and t tables of a word, C and T of the
restaurant, p = (c - d t + (theta + d T) p_parent) / (theta + C), and the root's customers are the
contexts' tables. Discounts d are n1 / (n1 + 2 n2) of the level's counts. Unknown words and contexts
fall back to the parent, so the probabilities over V + 1 tokens sum to one.

Seating is sampled by Gibbs: a sweep seats, for each word of each restaurant, its customers anew given
all others, drawing t from its exact conditional (generalised Stirling numbers). Beyond ``EXACT``
customers they are seated one after another, in leaps of a sixteenth of those that sit. The
restaurants of a sweep draw side by side from the totals before it. A word with one customer has one
table, so only counts of 2 and more are sampled. Predictive probabilities are means over the sweeps
after ``burn``, the root's first, then the contexts' with it. Draws depend on seed, sweep and part alone, so a task run again repeats them.

Nothing but totals passes the driver:

1. pairs are counted over all training texts and combined before the shuffle. They are dealt out by
   context over parts of about ``ENTRIES`` of them, by both words where a sample shows a context of
   that many (this changes where the work is done, not its result);
2. a part keeps its restaurants (a *room*), and sends each word's numbers to the word's *shard*;
3. per sweep, shards seat the root and answer with the words' root counts, rooms seat their customers
   and send back tables per word: aligned arrays, one per room and shard that share words;
4. all texts are read again, in ``SLICES`` slices one after another (a row's slice is a hash of it), their
   pairs go to the rooms, and per-text sums of logs come back; a slice's shuffles go before the next one's
   come. The rooms know how often each pair occurs in all training texts, so a text's score does not depend
   on its slice. Pairs of more than ``ENTRIES`` occurrences (few again) are scored where they are read.

Words are known by 64-bit hashes (two of ten million share one once in some 10**5 corpora). Repeated rows
are texts of their own; very long texts and ties need no care; an empty table gives no rows, and without
training texts N and V are 0 and all scores too. Only doc_id, text and the training column are read.
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import lean, release, scratch, ship
from outletlens.llm.hashing import mix
from outletlens.llm.wordhash import kinds, word_chunks

#: Texts are parted by a byte that UTF-8 has not.
KIND = kinds(b"\x20\x09\x0a\x0b\x0c\x0d", b"\xff")
START, END = np.uint64(2), np.uint64(1)
ENTRIES = 1 << 21
#: Frequent contexts are found in a sample of so many bytes, or this share of a larger table.
SAMPLE_BYTES, SAMPLE_SHARE = 1 << 25, 1e-3
#: Pairs that a task gathers before it sends them on, without and with their texts.
GATHER, GATHER_TEXTS = 1 << 20, 3 << 18
#: Slices of the texts that are scored one after another, where there is more than one part.
SLICES = 3
EXACT = 64
THETA = 1.0
_MAIL = "kind string, key long, other long, data binary"
_SUMS = "doc_id long, train boolean, n long, known long, base double, score double"
#: Texts whose sums a task adds up before it sends them on.
ADD_TEXTS = 1 << 20


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the fewest bytes that hold them all."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.dtype == np.int64 and x.min(initial=0) >= 0 else x


def _pack(**arrays) -> bytes:
    arrays = {k: np.ascontiguousarray(_small(x)) for k, x in arrays.items()}
    head = ";".join(f"{k},{x.dtype.str},{len(x)}" for k, x in arrays.items()).encode()
    return b"".join((struct.pack("<i", len(head)), head, *[x.tobytes() for x in arrays.values()]))


def _unpack(raw) -> dict:
    at = 4 + struct.unpack_from("<i", raw)[0]
    out = {}
    for field in bytes(raw[4:at]).decode().split(";"):
        name, kind, n = field.split(",")
        out[name] = np.frombuffer(raw, kind, int(n), at)
        at += out[name].nbytes
    return out


def _sparse(name: str, x: np.ndarray) -> dict:
    """Counts that mostly are 1."""
    more = np.flatnonzero(x != 1)
    return {f"{name}size": np.array([len(x)]), f"{name}gap": np.diff(more, prepend=0), f"{name}more": x[more]}


def _full(g: dict, name: str) -> np.ndarray:
    out = np.ones(int(g[f"{name}size"][0]), np.int64)
    out[np.cumsum(g[f"{name}gap"].astype(np.int64))] = g[f"{name}more"]
    return out


def _words_of(word: np.ndarray) -> dict:
    """Words as places in the list of different ones."""
    known, at = np.unique(word, return_inverse=True)
    return {"w": known, "wat": at}


def _pairs_of(got: list):
    """Contexts and words of blocks, one after another."""
    none = [np.zeros(0, np.uint64)]
    return (np.concatenate([np.repeat(g["u"], g["run"].astype(np.int64)) for g in got] or none),
            np.concatenate([g["w"][g["wat"]] for g in got] or none))


def _mail(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "other", "data"])


def _split(part: np.ndarray):
    """Slices of a sorted array of numbers: (number, from, to)."""
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    return zip(part[first].tolist(), first.tolist(), [*first.tolist()[1:], len(part)], strict=True)


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _in(x: np.ndarray, known: np.ndarray):
    """Places of x in the sorted array, and whether it is there."""
    at = np.searchsorted(known, x)
    here = at < len(known)
    here[here] = known[at[here]] == x[here]
    return np.where(here, at, 0), here


def _text_pairs(texts: list):
    """(first text, contexts, words, text of each pair) of chunks of texts."""
    for lo, n, _, starts, _, hashes, text, _ in word_chunks(texts, KIND):
        count = np.bincount(text, minlength=n)
        owner = np.repeat(np.arange(n), count + 1)
        last = np.cumsum(count + 1) - 1
        word = np.empty(len(owner), np.uint64)
        body = np.ones(len(owner), bool)
        body[last] = False
        word[body] = np.where(hashes <= START, hashes + np.uint64(3), hashes)
        word[last] = END
        context = np.concatenate(([START], word[:-1]))
        context[last[:-1] + 1] = START
        yield lo, context, word, owner


def _frequent_contexts(share: float):
    """Per chunk of texts: contexts with at least this share of its tokens, and their counts."""
    def run(batches):
        for pdf in batches:
            for _, context, _, _ in _text_pairs(pdf.text.tolist()):
                keys, n = np.unique(context, return_counts=True)
                use = n >= share * len(context)
                yield pd.DataFrame({"key": keys[use].view(np.int64), "n": n[use]})
    return lean(run)


class _Route:
    """The part of a pair: by its context, by both words where the context is frequent."""

    def __init__(self, bits: int, hot):
        self.bits, self.hot = bits, hot

    def __call__(self, context, word):
        frequent = _in(context, np.frombuffer(self.hot.value, np.uint64))[1]
        return np.where(frequent, mix(context ^ mix(word)), mix(context))

    def deal(self, context, word):
        """(part, places of its pairs in their order)."""
        part = _top(self(context, word), self.bits)
        order = np.argsort(part.astype(np.uint16) if self.bits <= 16 else part, kind="stable")
        return ((p, order[a:b]) for p, a, b in _split(part[order]))


def _new(*columns) -> np.ndarray:
    """Whether an entry differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _pair_counts(route):
    """Per task: counts of its distinct pairs (training, all), dealt to parts."""
    def run(batches):
        waiting = []

        def send():
            context, word, train = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            rows = []
            for p, i in route.deal(context, word):
                u, w = context[i], word[i]
                order = np.lexsort((w, u))
                u, w, t = u[order], w[order], train[i][order].astype(np.int64)
                first = np.flatnonzero(_new(u, w))
                n, c = np.diff(first, append=len(order)), np.add.reduceat(t, first)
                u, w = u[first], w[first]
                new = np.flatnonzero(_new(u))
                rows.append(("pairs", p, 0, _pack(u=u[new], run=np.diff(new, append=len(u)), **_words_of(w), **_sparse("c", c),
                                                  **_sparse("h", n - c + 1))))
            return _mail(rows)

        for pdf in batches:
            train = pdf.train.to_numpy(bool)
            for lo, context, word, owner in _text_pairs(pdf.text.tolist()):
                waiting.append((context, word, train[lo + owner]))
                if sum(len(x[0]) for x in waiting) >= GATHER:
                    yield send()
        if waiting:
            yield send()
    return lean(run)


def _types(context, word, sums):
    """Distinct pairs in order of (context, word), summed columns, and the pair of each entry (in ``order``)."""
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]))) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return context[first], word[first], [np.add.reduceat(s[order], first) if len(first) else s[order] for s in sums], np.cumsum(new) - 1, order


def _build_rooms(bits: int, hot, entries: int):
    def run(key, pdf):
        part = int(key[0])
        got = [_unpack(d) for d in pdf.data]
        sums = [np.concatenate([_full(g, "c") for g in got]), np.concatenate([_full(g, "h") - 1 for g in got])]
        context, word, (c, h) = _types(*_pairs_of(got), sums)[:3]
        new = _new(context)
        contexts, at_u = context[new], np.cumsum(new) - 1
        lanes, at_w = np.unique(_lane(word), return_inverse=True)
        one, many = c == 1, c > 1
        again = one & (h > 0)                            # one customer, but other texts ask for it too
        single = np.bincount(at_u[one], minlength=len(contexts))
        slices = [(q, a, b) for q, a, b in _split(_top(lanes, bits))]
        place, here = _in(contexts, np.frombuffer(hot.value, np.uint64))
        rows = [("room", part, 0, _pack(single=single, shards=np.array([q for q, _, _ in slices]), sizes=np.array([b - a for _, a, b in slices]),
                                        u=at_u[many], w=at_w[many], c=c[many], frequent=np.flatnonzero(here), names=contexts[here])),
                ("names", part, 0, _pack(contexts=contexts, lanes=lanes, seated=np.bincount(at_u, c, len(contexts)).astype(np.int64),
                                         again_u=at_u[again], again_w=at_w[again],
                                         **{k: np.bincount(at_w, x, len(lanes)).astype(np.int64) for k, x in (("c", c), ("one", one), ("many", many))})),
                ("tally", 0, 0, _pack(x=np.array([one.sum(), (c == 2).sum()])))]
        full = c + h >= entries
        if full.any():
            rows.append(("full", part, 0, _pack(u=context[full], w=word[full])))
        if here.any():
            seated = np.bincount(at_u, c, len(contexts)).astype(np.int64)
            tables = single + np.bincount(at_u[many], minlength=len(contexts))
            rows.append(("hot", part, 0, _pack(u=contexts[here], seated=seated[here], tables=tables[here])))
        return _mail(rows)
    return run


def _requests(bits: int):
    """A room's words and their numbers, cut up by shard."""
    def run(batches):
        for pdf in batches:
            for part, data in zip(pdf.key.tolist(), pdf.data, strict=True):
                g = _unpack(data)
                yield _mail([("request", q, part, _pack(**{k: g[k][a:b] for k in ("lanes", "c", "one", "many")}))
                             for q, a, b in _split(_top(g["lanes"], bits))])
    return run


def _lane(words: np.ndarray) -> np.ndarray:
    return mix(mix(words))


def _build_shards(key, pdf):
    q = int(key[0])
    got = [(p, _unpack(d)) for p, d in sorted(zip(pdf.other.tolist(), pdf.data, strict=True), key=lambda x: x[0])]
    lanes = np.unique(np.concatenate([g["lanes"] for _, g in got]))
    c, one, many = (np.zeros(len(lanes), np.int64) for _ in range(3))
    at = [np.searchsorted(lanes, g["lanes"]) for _, g in got]
    for i, (_, g) in zip(at, got, strict=True):
        c[i] += g["c"]
        one[i] += g["one"]
        many[i] += g["many"]
    return _mail([("shard", q, 0, _pack(c=c, one=one, many=many, parts=np.array([p for p, _ in got]), size=np.array([len(i) for i in at]), at=np.concatenate(at))),
                  ("total", 0, 0, _pack(x=np.array([c.sum(), (c > 0).sum(), (one + many == 1).sum(), (one + many == 2).sum()])))])


def _places(shard: dict):
    """(part, places of its words in the shard)."""
    return zip(shard["parts"].tolist(), np.split(shard["at"].astype(np.int64), np.cumsum(shard["size"].astype(np.int64))[:-1]), strict=True)


def _answers(roots: dict, counts: bool):
    """What a shard tells the rooms: the root's probabilities of their words, as a mean over these
    samples of the root, and the words' training counts where asked for."""
    def run(key, pdf):
        q = int(key[0])
        mail = {k: _unpack(d) for k, d in zip(pdf.kind, pdf.data, strict=True)}
        p = np.mean([(mail[k]["left"] + _root(root)) / (THETA + root["C0"]) for k, root in roots.items()], axis=0).astype(np.float32)
        return _mail([("answer", part, q, _pack(p=p[i], **({"c": mail["shard"]["c"][i]} if counts else {}))) for part, i in _places(mail["shard"])])
    return run


def _stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers: [c, t], of seatings of c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(EXACT + 2)
    for c in range(1, EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.where(t <= c, c - d * t, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(np.isnan(stay[1:]), -np.inf, stay[1:]))
    return out


def seat(c: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of words with c customers each (0: none), in restaurants with ``others`` tables of
    other words, where a new table serves the word with probability ``base``."""
    t = np.minimum(c, 1)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    log_s = _stirling(d)
    for k in range(2, EXACT + 1):
        for lo in range(edges[k - 2], edges[k - 1], max(1, (1 << 20) // k)):
            i = order[lo:min(lo + max(1, (1 << 20) // k), edges[k - 1])]
            j = np.arange(k)
            logits = np.cumsum(np.log(THETA + d * (others[i, None] + j)) + np.log(base[i, None]), 1) + log_s[k, 1:k + 1]
            p = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
            t[i] = 1 + (p < rng.random(len(i))[:, None] * p[:, -1:]).sum(1)
    i = order[edges[-1]:]
    if len(i):
        many, sit, tables = c[i], np.ones(len(i), np.int64), np.ones(len(i), np.int64)
        while True:
            step = np.minimum(np.maximum(1, sit // 16), many - sit)
            if not step.any():
                break
            new = (THETA + d * (others[i] + tables)) * base[i]
            tables += rng.binomial(step, new / (sit - d * tables + new))
            sit += step
        t[i] = tables
    return t


def _root(model: dict) -> float:
    """Probability that the root gives to each token by its parent."""
    return (THETA + model["d0"] * model["T0"]) / (model["V"] + 1)


def _shard_step(model: dict, sweep: int):
    def run(key, pdf):
        q = int(key[0])
        mail = {}
        for kind, other, data in zip(pdf.kind, pdf.other.tolist(), pdf.data, strict=True):
            mail.setdefault(kind, {})[other] = _unpack(data)
        shard = mail["shard"][0]
        c = shard["one"].astype(np.int64)
        tables = mail.get("tables")
        if tables is None:
            c += shard["many"]                       # at first each word has one table in each restaurant
        else:
            for p, i in _places(shard):
                c[i] += tables[p]["tables"]
        old = mail["root"][0]["tables"].astype(np.int64) if "root" in mail else np.minimum(c, 1)
        t = seat(c, np.maximum(model["T0"] - old, 0), np.full(len(c), 1 / (model["V"] + 1)), model["d0"], np.random.default_rng((1, sweep, q)))
        return _mail([("root", q, 0, _pack(tables=t, left=(c - model["d0"] * t).astype(np.float32))),
                      ("total", 0, 0, _pack(x=np.array([c.sum(), t.sum()])))])
    return run


class _Room:
    """A part's restaurants, from its mail."""

    def __init__(self, room: dict):
        self.single, self.u, self.w, self.c, self.frequent = (room[k].astype(np.int64) for k in ("single", "u", "w", "c", "frequent"))
        self.names = room["names"]
        self.shards, self.sizes = room["shards"].tolist(), room["sizes"].astype(np.int64)

    def of_words(self, answers: dict, name: str) -> np.ndarray:
        """Per word what the shards answered, shard by shard."""
        return np.concatenate([answers[q][name] for q in self.shards]).astype(float)

    def own_tables(self, t: np.ndarray) -> np.ndarray:
        return self.single + np.bincount(self.u, t, len(self.single)).astype(np.int64)

    def all_of(self, own: np.ndarray, hot: dict, name: str) -> np.ndarray:
        """Numbers per restaurant; those of frequent contexts are summed over many rooms."""
        out = own.copy()
        out[self.frequent] = hot[name][np.searchsorted(hot["u"], self.names)]
        return out


def _room_step(model: dict, hot: dict, sweep: int):
    def run(key, pdf):
        part = int(key[0])
        mail = {}
        for kind, other, data in zip(pdf.kind, pdf.other.tolist(), pdf.data, strict=True):
            mail.setdefault(kind, {})[other] = _unpack(data)
        room = _Room(mail["room"][0])
        old = mail["state"][0]["t"].astype(np.int64) if "state" in mail else np.ones(len(room.c), np.int64)
        base = room.of_words(mail["answer"], "p")[room.w]
        others = room.all_of(room.own_tables(old), hot, "tables")[room.u] - old
        t = seat(room.c, np.maximum(others, 0), base, model["d1"], np.random.default_rng((2, sweep, part)))
        ends = np.cumsum(room.sizes)
        of_word = np.bincount(room.w, t, ends[-1]).astype(np.int64)
        rows = [("state", part, 0, _pack(t=t))]
        rows += [("tables", q, part, _pack(tables=of_word[b - n:b])) for q, n, b in zip(room.shards, room.sizes, ends, strict=True)]
        if len(room.names):
            rows.append(("hot", part, 0, _pack(u=room.names, tables=room.own_tables(t)[room.frequent])))
        return _mail(rows)
    return run


class _Scorer:
    """A room with its words' counts and its samples: what pairs of it are worth."""

    def __init__(self, pdf, rounds: list, model: dict):
        mail = {}
        for kind, other, data in zip(pdf.kind, pdf.other.tolist(), pdf.data, strict=True):
            mail.setdefault(kind, {})[other] = _unpack(data)
        self.room, self.model, names = _Room(mail["room"][0]), model, mail["names"][0]
        self.contexts, self.lanes = names["contexts"], names["lanes"]
        self.seated = self.room.all_of(names["seated"].astype(np.int64), rounds[0][1], "seated")
        counts = self.room.of_words(mail["answer"], "c")
        self.known = counts > 0
        self.base = np.log10((counts + 1) / (model["N"] + model["V"] + 1))
        self.parent, self.samples = self.room.of_words(mail["answer"], "p"), []
        for k, hot in rounds:
            t = mail[f"state{k}"][0]["t"].astype(np.int64)
            back_off = (THETA + model["d1"] * self.room.all_of(self.room.own_tables(t), hot, "tables")) / (THETA + self.seated)
            self.samples.append((t, back_off))

        sampled = self.room.u << 32 | self.room.w
        self.order = np.argsort(sampled)
        self.sampled = sampled[self.order]
        self.again = np.sort(names["again_u"].astype(np.int64) << 32 | names["again_w"].astype(np.int64))

    def find(self, context, word):
        """Places of pairs' contexts and words, and among the room's sampled pairs (and whether there)."""
        u, w = np.searchsorted(self.contexts, context), np.searchsorted(self.lanes, _lane(word))
        at, here = _in(u << 32 | w, self.sampled)
        return u, w, np.where(here, self.order[at], 0) if len(self.order) else at, here

    def customers(self, u, w, at, many, trained):
        """Customers of pairs: two or more are kept by the room, and a training text has those with one,
        which the room keeps where a text outside training has them as well."""
        c = (trained | _in(u << 32 | w, self.again)[1]).astype(np.int64)
        c[many] = self.room.c[at[many]]
        return c

    def __call__(self, u, w, c, at):
        """Base and model logs of pairs with c customers, and whether their words are known."""
        p = np.zeros(len(u))
        for t, back_off in self.samples:
            tables = np.minimum(c, 1)
            tables[c > 1] = t[at[c > 1]]
            p += np.where(c > 0, c - self.model["d1"] * tables, 0.0) / (THETA + self.seated[u]) + back_off[u] * self.parent[w]
        return self.base[w], np.log10(p / len(self.samples)), self.known[w]


def _full_pairs(rounds: list, model: dict):
    """Scores of a room's most frequent pairs, for the tasks that read them."""
    def run(key, pdf):
        scorer = _Scorer(pdf[pdf.kind != "full"], rounds, model)
        full = _unpack(pdf.data[pdf.kind == "full"].iloc[0])
        u, w, at, many = scorer.find(full["u"], full["w"])
        u, w, at = u[many], w[many], at[many]                 # the others are rare in training texts, and not kept
        base, score, known = scorer(u, w, scorer.room.c[at], at)
        return pd.DataFrame({"u": full["u"][many].view(np.int64), "w": full["w"][many].view(np.int64), "base": base, "score": score, "known": known})
    return run


def _text_blocks(route, full, parts: int):
    """Per task: its pairs with their texts, dealt to parts; pairs that have scores already as sums."""
    def run(batches):
        ready = _unpack(full.value)
        waiting, texts = [], []

        def send():
            context, word, owner = (np.concatenate(x) for x in zip(*waiting, strict=True))
            row, doc, missing, train = (np.array(x) for x in zip(*texts, strict=True))
            waiting.clear()
            texts.clear()
            of = {"row0": row[:1], "size": np.array([len(row)])}          # a block is known by its first row
            sums = {k: np.zeros(len(row)) for k in ("known", "base", "score")}
            n = np.bincount(owner, minlength=len(row))
            if len(ready["key"]):
                at, here = _in(mix(context ^ mix(word)), ready["key"])
                if here.any():
                    sums = {k: np.bincount(owner[here], ready[k][at[here]], len(row)) for k in sums}
                    context, word, owner = context[~here], word[~here], owner[~here]
            rows = [("block", parts + int(mix(row[:1].astype(np.uint64))[0] % np.uint64(4096)), 0,
                     _pack(doc=doc, missing=missing, train=train, n=n, **sums, **of))]
            trained = np.packbits(train)
            for p, i in route.deal(context, word):
                u, w, o = context[i], word[i], owner[i]
                order = np.lexsort((w, u))                     # stable: a pair's texts stay in order
                u, w, o = u[order], w[order], o[order]
                first = np.flatnonzero(_new(u, w, o))
                many = np.diff(first, append=len(order))
                u, w, o = u[first], w[first], o[first]
                pair = np.flatnonzero(_new(u, w))
                texts_of = np.diff(pair, append=len(o))
                u, w = u[pair], w[pair]
                new = np.flatnonzero(_new(u))
                rows.append(("block", p, 0, _pack(u=u[new], run=np.diff(new, append=len(u)), **_words_of(w), **_sparse("texts", texts_of),
                                                  owner=o, **_sparse("many", many), trained=trained, **of)))
            return _mail(rows)

        for pdf in batches:
            about = list(zip(pdf.row.tolist(), [0 if d is None else int(d) for d in pdf.doc_id], [d is None for d in pdf.doc_id],
                             pdf.train.tolist(), strict=True))
            for lo, context, word, owner in _text_pairs(pdf.text.tolist()):
                waiting.append((context, word, owner + len(texts)))
                texts += about[lo:lo + int(owner[-1]) + 1]
                if sum(len(x[0]) for x in waiting) >= GATHER_TEXTS:
                    yield send()
        if waiting:
            yield send()
    return lean(run)


def _score_blocks(rounds: list, model: dict, parts: int):
    """Per block: sums of its texts over one part's pairs."""
    def run(key, pdf):
        part = int(key[0])
        sent = pdf.data[pdf.kind == "block"].tolist()
        blocks = [_unpack(d) for d in sent]
        if part >= parts:
            return _mail([("texts", int(b["row0"][0]), 0, d) for b, d in zip(blocks, sent, strict=True)])
        if not blocks:
            return _mail([])
        scorer = _Scorer(pdf[pdf.kind != "block"], rounds, model)
        entries, trained = [], []
        for b in blocks:
            of, owner = np.repeat(np.arange(len(b["wat"])), _full(b, "texts")), b["owner"].astype(np.int64)
            entries.append((of, owner, _full(b, "many")))
            trained.append(np.bincount(of, np.unpackbits(b["trained"])[owner], len(b["wat"])).astype(np.int64))
        context, word, (trained,), pair, order = _types(*_pairs_of(blocks), [np.concatenate(trained)])
        u, w, at, many = scorer.find(context, word)
        scores = scorer(u, w, scorer.customers(u, w, at, many, trained > 0), at)
        back = np.empty(len(order), np.int64)
        back[order] = pair
        rows, at = [], 0
        for b, (of, owner, many) in zip(blocks, entries, strict=True):
            mine = back[at + of]
            at += len(b["wat"])
            size = int(b["size"][0])
            texts = np.flatnonzero(np.bincount(owner, minlength=size))
            base, score, known = (np.bincount(owner, many * s[mine], size)[texts] for s in scores)
            rows.append(("sums", int(b["row0"][0]), part, _pack(size=b["size"], texts=texts, known=known.astype(np.int64), base=base, score=score)))
        return _mail(rows)
    return run


def _add_sums(total: dict, b: dict) -> None:
    for k, x in total.items():
        x[b["texts"]] += b[k]                            # a text comes once


def _add_blocks(batches):
    """The sums of a block's texts over all parts of a task."""
    waiting = {}

    def send():
        rows = []
        for row0, total in waiting.items():
            texts = np.flatnonzero((total["score"] != 0) | (total["base"] != 0))
            rows.append(("sums", row0, 0, _pack(size=np.array([len(total["score"])]), texts=texts, known=total["known"][texts],
                                                base=total["base"][texts], score=total["score"][texts])))
        waiting.clear()
        return _mail(rows)

    for pdf in batches:
        yield pdf[pdf.kind == "texts"]
        for kind, row0, data in zip(pdf.kind, pdf.key.tolist(), pdf.data, strict=True):
            if kind == "sums":
                b = _unpack(data)
                size = int(b["size"][0])
                _add_sums(waiting.setdefault(row0, {"known": np.zeros(size, np.int64), "base": np.zeros(size), "score": np.zeros(size)}), b)
                if sum(len(x["score"]) for x in waiting.values()) >= ADD_TEXTS:
                    yield send()
    if waiting:
        yield send()


def _texts_of_block(key, pdf):
    about = _unpack(pdf.data[pdf.kind == "texts"].iloc[0])
    total = {"known": about["known"].astype(np.int64), "base": about["base"].copy(), "score": about["score"].copy()}
    for d in pdf.data[pdf.kind == "sums"]:
        _add_sums(total, _unpack(d))
    doc = pd.Series(about["doc"].astype(np.int64), dtype="Int64")
    doc[about["missing"]] = pd.NA
    return pd.DataFrame({"doc_id": doc, "train": about["train"], "n": about["n"].astype(np.int64), **total})


def _add(table: DataFrame, kind: str) -> np.ndarray:
    """Sum of the small vectors of one kind, added up in tasks."""
    def run(batches):
        for pdf in batches:
            for d in pdf.data:
                yield pd.DataFrame({"at": range(len(x := _unpack(d)["x"])), "x": x})
    rows = table.where(F.col("kind") == kind).select("data").mapInPandas(run, "at int, x long").groupBy("at").agg(F.sum("x").alias("x")).collect()
    return np.array([r.x for r in sorted(rows, key=lambda r: r.at)], np.int64)


def _hot_totals(table: DataFrame, seated: bool = False) -> dict:
    """Tables (and customers) of the frequent contexts (at most 2 * tokens / ENTRIES), over all rooms."""
    def run(batches):
        for pdf in batches:
            for d in pdf.data:
                x = _unpack(d)
                yield pd.DataFrame({"u": x["u"].view(np.int64), "seated": x.get("seated", x["tables"]), "tables": x["tables"]})
    rows = (table.where("kind = 'hot'").select("data").mapInPandas(run, "u long, seated long, tables long")
            .groupBy("u").agg(F.sum("seated").alias("seated"), F.sum("tables").alias("tables")).toPandas())
    u = rows.u.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(u)
    return {"u": u[order], "tables": rows.tables.to_numpy(np.int64)[order]} | ({"seated": rows.seated.to_numpy(np.int64)[order]} if seated else {})


def _discount(one: int, two: int) -> float:
    return float(min(0.95, max(0.05, one / (one + 2 * two) if one + two else 0.5)))


def _of(table: DataFrame, *names, rename: str | None = None) -> DataFrame:
    out = table.where(F.col("kind").isin(*names))
    return out.withColumn("kind", F.lit(rename)) if rename else out


def score_texts(docs: DataFrame, train: Column, sweeps: int = 3, burn: int = 1, entries: int = ENTRIES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, train, n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score (log10 probability by the model of the texts where ``train`` holds)."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text") + 6)).first()[0] or 0
    bits = max(0, (int(size) // 6 // entries).bit_length())
    # as for the borders of a range shuffle, a sample tells how to deal pairs out; results do not depend on it
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(1, size)))
    found = docs.sample(share, 1).select("text").mapInPandas(_frequent_contexts(share * entries / 2 / max(1, share * size // 4)), "key long, n long")
    frequent = found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= share * entries / 2).select("key").collect()
    hot_words = sc.broadcast(np.sort(np.array([r.key for r in frequent], np.int64).view(np.uint64)).tobytes())
    route = _Route(bits, hot_words)
    rooms = scratch(docs.select("text", "train").mapInPandas(_pair_counts(route), _MAIL).groupBy("key").applyInPandas(_build_rooms(bits, hot_words, entries), _MAIL), "lm-rooms")
    release(spark)
    shards = scratch(_of(rooms, "names").mapInPandas(lean(_requests(bits)), _MAIL).groupBy("key").applyInPandas(_build_shards, _MAIL), "lm-shards")
    totals = _add(shards, "total")
    if not len(totals):
        totals = np.zeros(4, np.int64)
    tally = _add(rooms, "tally")
    model = {"N": int(totals[0]), "V": int(totals[1]), "d0": _discount(int(totals[2]), int(totals[3])),
             "d1": _discount(*(tally.tolist() if len(tally) else (0, 0))), "T0": int(totals[1]), "C0": 0}
    hot, mail, state, rounds, kept, roots = _hot_totals(rooms, True), _of(shards, "shard"), None, [], [], {}
    for sweep in range(sweeps + 1):
        root = scratch(mail.groupBy("key").applyInPandas(_shard_step(model, sweep), _MAIL), "lm-root")
        found = _add(root, "total")
        if len(found):
            model = {**model, "C0": int(found[0]), "T0": int(found[1])}
        if sweep > burn or (sweep and sweep == sweeps):
            rounds.append((sweep, hot))
            roots[f"root{sweep}"] = dict(model)
            kept.append((_of(root, "root", rename=f"root{sweep}"), _of(state, "state", rename=f"state{sweep}")))
        if sweep == sweeps:
            break
        answers = _of(shards, "shard").unionByName(_of(root, "root")).groupBy("key").applyInPandas(_answers({"root": model}, False), _MAIL)
        seats = _of(rooms, "room").unionByName(answers)
        if state is not None:
            seats = seats.unionByName(_of(state, "state"))
        state = scratch(seats.groupBy("key").applyInPandas(_room_step(model, hot, sweep), _MAIL), "lm-seats")
        hot = hot | _hot_totals(state)
        mail = _of(shards, "shard").unionByName(_of(root, "root")).unionByName(_of(state, "tables"))
    release(spark)
    ready, asked = _of(rooms, "room", "names"), _of(shards, "shard")
    for root, state in kept:
        ready, asked = ready.unionByName(state), asked.unionByName(root)
    ready = ready.unionByName(asked.groupBy("key").applyInPandas(_answers(roots, True), _MAIL))
    parts = 1 << bits
    keys = _of(rooms, "full").select("key")
    full = (ready.join(keys, "key", "left_semi").select("kind", "key", "other", "data").unionByName(_of(rooms, "full"))
            .groupBy("key").applyInPandas(_full_pairs(rounds, model), "u long, w long, base double, score double, known boolean"))
    full = full.toPandas()                                  # at most tokens / ENTRIES rows
    u, w = (full[x].to_numpy(np.int64).view(np.uint64) for x in "uw")
    key = mix(u ^ mix(w))
    order = np.argsort(key)
    full = sc.broadcast(_pack(u=u[order], key=key[order], **{x: full[x].to_numpy()[order].astype(float) for x in ("base", "score", "known")}))
    slices = SLICES if bits else 1
    scored = []
    for k in range(slices):
        texts = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k) if slices > 1 else docs
        # a block is known by its first row's number, within one reading of the table only
        texts = texts.withColumn("row", F.monotonically_increasing_id())
        blocks = texts.mapInPandas(_text_blocks(route, full, parts), _MAIL)
        sums = blocks.unionByName(ready).groupBy("key").applyInPandas(_score_blocks(rounds, model, parts), _MAIL)
        out = sums.mapInPandas(lean(_add_blocks), _MAIL).groupBy("key").applyInPandas(_texts_of_block, _SUMS)
        out = out.select("doc_id", "train", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
                         F.lit(model["N"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
        if slices > 1:
            out = scratch(out, "lm-scores")
            del blocks, sums
            release(spark)
        scored.append(out)
    return reduce(DataFrame.unionByName, scored)
