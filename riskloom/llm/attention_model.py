"""A small causal self-attention model over subword ids, trained and applied in numpy.

One attention layer and one feed-forward layer over windows of WINDOW ids.  A
window scores its last STRIDE places; the CONTEXT places before them are shared
with the window before, so each id is scored once.  The output is a softmax
over classes and one over the members of the class; classes are runs of equal
length in the order of corpus frequency.  Both add the logits of the attention
state to the log shares of what follows the last id in the whole training
corpus, so the layers learn what the last id alone does not tell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
WIDTH, HIDDEN = 16, 32
CLASSES, MEMBERS = 32, 32
LEAVES = CLASSES * MEMBERS
START = LEAVES  # the id before a text; never predicted
BATCH = 256
HIDE = np.float32(-1e9)
BACK_OFF = 5.0  # weight of the overall shares among the followers of an id
LARGEST = 60.0  # exponents up to this need no shift
TRAINED = ("ids", "places", "q", "k", "v", "o", "in", "in_bias", "out", "class", "member")
REFINE_BATCH, REFINE_RATE = 256, 0.002


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    class_prior: np.ndarray  # (LEAVES + 1, CLASSES): log share of each class after an id
    member_prior: np.ndarray  # ((LEAVES + 1) * CLASSES, MEMBERS): log share within the class

    def tables(self) -> "Model":
        """Adds what each id and each place contribute to state, queries, keys and values, so scoring only looks them up."""
        w = self.weights
        for name, by in (("x", np.eye(WIDTH)), ("query", w["q"] / np.sqrt(WIDTH)), ("key", w["k"]), ("value", w["v"] @ w["o"])):
            w[f"id_{name}"], w[f"place_{name}"] = (w["ids"] @ by).astype(np.float32), (w["places"] @ by).astype(np.float32)
        return self


def _mask() -> np.ndarray:
    return np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), np.float32(0), HIDE)


def follower_priors(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares by class and by member from counts (LEAVES + 1, LEAVES) of which leaf follows which."""
    overall = pairs.sum(axis=0) + 0.5
    share = pairs + BACK_OFF * overall / overall.sum()
    share = (share / share.sum(axis=1, keepdims=True)).reshape(LEAVES + 1, CLASSES, MEMBERS)
    by_class = share.sum(axis=2)
    within = np.log(share / by_class[:, :, None])
    return np.log(by_class).astype(np.float32), within.reshape(-1, MEMBERS).astype(np.float32)


def initial(pairs: np.ndarray, rng: np.random.Generator) -> Model:
    """Random weights and the priors of the corpus."""
    def draw(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    s = WIDTH ** -0.5
    return Model({
        "ids": draw(LEAVES + 1, WIDTH, scale=0.3), "places": draw(WINDOW, WIDTH, scale=0.1),
        "q": draw(WIDTH, WIDTH, scale=s), "k": draw(WIDTH, WIDTH, scale=s), "v": draw(WIDTH, WIDTH, scale=s), "o": draw(WIDTH, WIDTH, scale=0.3 * s),
        "in": draw(WIDTH, HIDDEN, scale=s), "in_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, WIDTH, scale=0.5 * HIDDEN ** -0.5),
        "class": draw(WIDTH, CLASSES, scale=0.1), "member": draw(CLASSES, WIDTH, MEMBERS, scale=0.1),
    }, *follower_priors(pairs))


def _wide(x: np.ndarray) -> bool:
    """Whether exponents are too far from zero to do without a shift."""
    return max(x.max(initial=0), -x.min(initial=0)) > LARGEST


def _shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each row in place, and the log of their common divisor."""
    top = x.max(axis=-1, keepdims=True) if _wide(x) else None
    if top is not None:
        x -= top
    np.exp(x, out=x)
    whole = x @ np.ones((x.shape[-1], 1), np.float32)
    x /= whole
    log = np.log(whole)
    return x, (log if top is None else log + top)[..., 0]


def _exponentials(x: np.ndarray, wide: bool) -> np.ndarray:
    """exp in place, up to a factor per row that cancels in shares."""
    if wide:
        x -= x.max(axis=-1, keepdims=True)
    return np.exp(x, out=x)


def _total(rows: np.ndarray) -> np.ndarray:
    """Sum of all rows."""
    return np.ones(len(rows), np.float32) @ rows


def _hidden(w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Hidden units of states, 8 rows at a time, since numpy is slow on short rows and on single numbers."""
    u = h @ w["in"]
    wide = u.reshape(-1, 8 * HIDDEN)  # a window has a multiple of 8 places
    wide += np.tile(w["in_bias"], 8)
    np.maximum(wide, np.zeros(8 * HIDDEN, np.float32), out=wide)
    return u


def _summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each index."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at.astype(np.int16), kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    out[sorted_[first]] = np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)
    return out


def _step(model: Model, ids: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the places of windows whose target is a leaf, and its gradient.

    Places are sorted by the class of their target.  Attention is kept without
    its divisor, which goes to the WIDTH numbers of a place instead of its
    shares, and values are mixed as they go into the state (v and o in one).
    """
    w, scale = model.weights, np.float32(WIDTH ** -0.5)
    target = targets.ravel()
    kind = target // MEMBERS  # START has a class of its own behind the others
    by = np.argsort(kind.astype(np.uint8), kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(kind, minlength=CLASSES)[:CLASSES]))
    by = by[: ends[-1]]
    n, kind, last = max(1, len(by)), kind[by], ids.ravel()[by]
    cell = np.arange(len(by)) * MEMBERS
    x = np.take(w["ids"], ids, axis=0)
    x += w["places"]
    flat = x.reshape(-1, WIDTH)
    inner = np.concatenate([w["q"] * scale, w["k"], w["v"] @ w["o"]], axis=1)
    qkv = (flat @ inner).reshape(*ids.shape, 3 * WIDTH)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH: 2 * WIDTH], qkv[..., 2 * WIDTH:]
    a = q @ k.transpose(0, 2, 1)
    wide = _wide(a)
    a += mask
    a = _exponentials(a, wide)
    whole = a @ np.ones((WINDOW, 1), np.float32)
    mixed = a @ v
    mixed /= whole
    mixed = mixed.reshape(-1, WIDTH)
    h = flat + mixed
    u = _hidden(w, h)
    z = u @ w["out"]
    z += h
    z = np.take(z, by, axis=0)
    g = {}
    d = z @ w["class"]
    d += np.take(model.class_prior, last, axis=0)
    chosen = np.take(d, cell + kind)
    d, total = _shares(d)
    loss = float((total - chosen).sum())
    d.ravel()[cell + kind] -= 1
    g["class"] = z.T @ d
    dz = d @ w["class"].T
    e = np.empty((len(by), MEMBERS), np.float32)
    for c in range(CLASSES):
        np.matmul(z[ends[c]: ends[c + 1]], w["member"][c], out=e[ends[c]: ends[c + 1]])
    e += np.take(model.member_prior, last * CLASSES + kind, axis=0)
    member = cell + target[by] % MEMBERS
    chosen = np.take(e, member)
    e, total = _shares(e)
    loss += float((total - chosen).sum())
    e.ravel()[member] -= 1
    g["member"] = np.empty_like(w["member"])
    for c in range(CLASSES):
        part = e[ends[c]: ends[c + 1]]
        np.matmul(z[ends[c]: ends[c + 1]].T, part, out=g["member"][c])
        dz[ends[c]: ends[c + 1]] += part @ w["member"][c].T
    dh = np.zeros((target.size, WIDTH), np.float32)
    dh[by] = dz
    du = dh @ w["out"].T
    du *= u > 0
    g["out"], g["in"], g["in_bias"] = u.T @ dh, h.T @ du, _total(du)
    dh += du @ w["in"].T
    dm = dh / whole.reshape(-1, 1)
    same = np.einsum("ij,ij->i", dm, mixed)
    dm = dm.reshape(x.shape)
    ds = dm @ v.transpose(0, 2, 1)
    ds -= same.reshape(*ids.shape, 1)
    ds *= a
    dqkv = np.empty_like(qkv)
    np.matmul(ds, k, out=dqkv[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., WIDTH: 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dm, out=dqkv[..., 2 * WIDTH:])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    dh += dqkv @ inner.T
    inner = flat.T @ dqkv
    g["q"], g["k"] = inner[:, :WIDTH] * scale, inner[:, WIDTH: 2 * WIDTH]
    g["v"], g["o"] = inner[:, 2 * WIDTH:] @ w["o"].T, w["v"].T @ inner[:, 2 * WIDTH:]
    g["ids"] = _summed(dh, ids.ravel(), LEAVES + 1)
    g["places"] = _total(dh.reshape(len(ids), -1)).reshape(WINDOW, WIDTH)
    return loss / n, {name: value / np.float32(n) for name, value in g.items()}


class Adam:
    """Steps of a model's weights along averaged gradients."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.steps = weights, 0
        self.first = {name: np.zeros_like(value) for name, value in weights.items()}
        self.second = {name: np.zeros_like(value) for name, value in weights.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        pace = rate * (1 - 0.999 ** self.steps) ** 0.5 / (1 - 0.9 ** self.steps)
        for name, value in g.items():
            self.first[name] += 0.1 * (value - self.first[name])
            self.second[name] += 0.001 * (value * value - self.second[name])
            self.weights[name] -= (pace * self.first[name] / (np.sqrt(self.second[name]) + 1e-8)).astype(np.float32)


def train(streams: np.ndarray, pairs: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Model:
    """Fit to rows of WINDOW + 1 leaf ids (the last is only predicted) by Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    model = initial(pairs, rng)
    adam, mask = Adam(model.weights), _mask()
    for t in range(1, steps + 1 if len(streams) else 1):
        rows = streams[rng.integers(0, len(streams), batch)]
        _, g = _step(model, rows[:, :-1], rows[:, 1:], mask)
        adam.step(g, rate * (1 - (t - 1) / steps))
    return model.tables()


def packed_windows(leaves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of WINDOW + 1 ids that predict every leaf of the texts once; START opens each text and is never a target."""
    first = np.cumsum(lengths) - lengths
    stream = np.insert(leaves, first, START)
    rows = -(-(len(stream) - 1) // WINDOW) if len(stream) else 0
    padded = np.append(stream, np.full(rows * WINDOW + 1 - len(stream), START)) if rows else stream
    return padded[np.arange(rows)[:, None] * WINDOW + np.arange(WINDOW + 1)]


class Refiner:
    """Further steps of a fitted model over all windows that it is given; the weights of many refiners are averaged."""

    def __init__(self, model: Model, rate: float = REFINE_RATE):
        # the lookup tables of a fitted model follow from its weights
        self.model = Model({name: model.weights[name].copy() for name in TRAINED}, model.class_prior, model.member_prior)
        self.adam, self.rate, self.mask, self.seen = Adam(self.model.weights), rate, _mask(), 0

    def add(self, windows: np.ndarray, seed: int = 7) -> None:
        order = np.random.default_rng(seed).permutation(len(windows))
        for at in range(0, len(order), REFINE_BATCH):
            rows = windows[order[at: at + REFINE_BATCH]]
            _, g = _step(self.model, rows[:, :-1], rows[:, 1:], self.mask)
            self.adam.step(g, self.rate)
        self.seen += int((windows[:, 1:] < LEAVES).sum())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.model.weights[name].ravel() for name in TRAINED]).astype(np.float64)


def averaged(model: Model, flat: np.ndarray) -> Model:
    """The model with other weights, laid out as by ``Refiner.flat``."""
    weights, at = {}, 0
    for name in TRAINED:
        old = model.weights[name]
        weights[name] = flat[at: at + old.size].reshape(old.shape).astype(np.float32)
        at += old.size
    return Model(weights, model.class_prior, model.member_prior).tables()


def _states(w: dict[str, np.ndarray], ids: np.ndarray, opening: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Output states of the scored places of windows; ``opening`` marks those without earlier context."""
    def of(name: str, places: slice) -> np.ndarray:
        part = np.take(w[f"id_{name}"], ids[:, places], axis=0)
        part += w[f"place_{name}"][places]
        return part

    all_, scored = slice(0, WINDOW), slice(CONTEXT, WINDOW)
    a = of("query", scored) @ of("key", all_).transpose(0, 2, 1)
    wide = _wide(a)
    a += mask[CONTEXT:]
    a[opening, :, :CONTEXT] = HIDE
    a = _exponentials(a, wide)
    mixed = a @ of("value", all_)
    mixed /= a @ np.ones((WINDOW, 1), np.float32)
    mixed += of("x", scored)
    h = mixed.reshape(-1, WIDTH)
    u = _hidden(w, h) @ w["out"]
    u += h
    return u


def _picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of one entry of each row."""
    if _wide(logits):
        logits -= logits.max(axis=1, keepdims=True)
    chosen = np.take(logits, np.arange(len(at)) * logits.shape[1] + at)
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(logits.shape[1], np.float32))


def score(model: Model, leaves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural-log probability of each leaf of the texts laid end to end, each given the leaves before it."""
    w, mask = model.weights, _mask()
    first = np.cumsum(lengths) - lengths
    previous = np.append(START, leaves[:-1]).astype(np.int64)
    previous[first[lengths > 0]] = START
    out = np.zeros(len(leaves), np.float32)
    windows = -(-lengths // STRIDE)
    number = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.repeat(first, windows) + number * STRIDE
    size = np.minimum(STRIDE, np.repeat(first + lengths, windows) - begin)
    padded = np.concatenate([np.full(CONTEXT, START), previous, np.full(STRIDE, START)])  # window places before and after all texts
    place, inside = np.arange(WINDOW), np.arange(STRIDE)
    for at in range(0, len(begin), BATCH):
        b, opening = begin[at: at + BATCH], number[at: at + BATCH] == 0
        z = _states(w, padded[b[:, None] + place], opening, mask)
        real = np.flatnonzero((inside < size[at: at + BATCH, None]).ravel())
        where = (b[:, None] + inside).ravel()[real]
        z, target, last = np.take(z, real, axis=0), leaves[where], previous[where]
        kind = target // MEMBERS
        logits = z @ w["class"]
        logits += np.take(model.class_prior, last, axis=0)
        got = _picked(logits, kind)
        by = np.argsort(kind.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=CLASSES))
        z, logits = np.take(z, by, axis=0), np.empty((len(by), MEMBERS), np.float32)
        for c in range(CLASSES):
            lo, hi = (ends[c - 1] if c else 0), ends[c]
            if hi > lo:
                np.matmul(z[lo:hi], w["member"][c], out=logits[lo:hi])
        logits += np.take(model.member_prior, (last * CLASSES + kind)[by], axis=0)
        got[by] += _picked(logits, (target % MEMBERS)[by])
        out[where] = got
    return out
