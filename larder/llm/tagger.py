"""A small character tagger in numpy: embedding, bidirectional LSTM, CRF; training and decoding.

Models are dictionaries of arrays. Tags are 0 for outside and 1 + 2k, 2 + 2k for the first and
the later characters of a span of kind k.
"""

from __future__ import annotations

import random
import string
from collections.abc import Sequence

import numpy as np

HIDDEN, EMBEDDED = 16, 12
NEVER = -1e4
# Classes of characters: lower and upper case, digits, each ASCII mark, spaces, line ends, others.
CLASSES = np.full(0x3000, 4, np.int8)
CLASSES[ord("a") : ord("z") + 1] = 1
CLASSES[ord("A") : ord("Z") + 1] = 2
CLASSES[ord("0") : ord("9") + 1] = 3
CLASSES[[9, 32]] = 5
CLASSES[[10, 13]] = 6
for _i, _mark in enumerate(string.punctuation):
    CLASSES[ord(_mark)] = 7 + _i
N_CLASSES = 7 + len(string.punctuation)  # class 0 stands beyond the end of a text


def encode(texts: Sequence[str], width: int) -> np.ndarray:
    """The classes of the characters, a row for each text."""
    joined = "".join(t[:width].ljust(width, "\0") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = CLASSES[np.minimum(codes, len(CLASSES) - 1)]
    return np.where(codes == 0, 0, classes).reshape(len(texts), width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(table: np.ndarray, recurrent: np.ndarray, codes: np.ndarray, keep: bool):
    """Hidden states (time, rows, hidden) of an LSTM whose input weights are folded in a table."""
    h = np.zeros((codes.shape[0], recurrent.shape[0]))
    c = np.zeros_like(h)
    n = recurrent.shape[0]
    states, trace = [], []
    for t in range(codes.shape[1]):
        gates = table[codes[:, t]] + h @ recurrent
        gates[:, : 3 * n] = _sigmoid(gates[:, : 3 * n])
        gates[:, 3 * n :] = np.tanh(gates[:, 3 * n :])
        i, f, o, g = (gates[:, k * n : (k + 1) * n] for k in range(4))
        before = c, h
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states.append(h)
        if keep:
            trace.append((gates, squashed, *before))
    return np.stack(states), trace


def _lstm_back(model: dict, side: str, codes: np.ndarray, trace: list, grad: np.ndarray, to: dict):
    """Gradients of the LSTM's weights and of the embedding, given those of its states."""
    recurrent = model[f"{side}_recurrent"]
    n = recurrent.shape[0]
    table_grad = np.zeros((N_CLASSES, 4 * n))
    dh = np.zeros_like(grad[0])
    dc = np.zeros_like(dh)
    for t in reversed(range(codes.shape[1])):
        gates, squashed, c_before, h_before = trace[t]
        i, f, o, g = (gates[:, k * n : (k + 1) * n] for k in range(4))
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        d = np.concatenate(
            [
                dc * g * i * (1 - i),
                dc * c_before * f * (1 - f),
                dh * squashed * o * (1 - o),
                dc * i * (1 - g**2),
            ],
            axis=1,
        )
        np.add.at(table_grad, codes[:, t], d)
        to[f"{side}_recurrent"] += h_before.T @ d
        dh = d @ recurrent.T
        dc = dc * f
    to[f"{side}_input"] += model["embedding"].T @ table_grad
    to[f"{side}_bias"] += table_grad.sum(axis=0)
    to["embedding"] += table_grad @ model[f"{side}_input"].T


def emissions(model: dict, codes: np.ndarray, keep: bool = False):
    """Scores (time, rows, tags) from both directions."""
    states, traces = [], []
    for side in ("forward", "backward"):
        seen = codes if side == "forward" else codes[:, ::-1]
        table = model["embedding"] @ model[f"{side}_input"] + model[f"{side}_bias"]
        h, trace = _lstm(table, model[f"{side}_recurrent"], seen, keep)
        states.append(h if side == "forward" else h[::-1])
        traces.append(trace)
    both = np.concatenate(states, axis=2)
    return both @ model["output"] + model["output_bias"], both, traces


def allowed(tags: int) -> np.ndarray:
    """0 where a tag may follow another, a very low score where it may not."""
    rules = np.zeros((tags, tags))
    for inside in range(2, tags, 2):
        rules[:, inside] = NEVER
        rules[[inside - 1, inside], inside] = 0
    return rules


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Log partition, tag probabilities (time, rows, tags) and expected moves, by forward-backward."""
    steps = len(scores)
    alpha = [scores[0] + first]
    for t in range(1, steps):
        alpha.append(scores[t] + _log_sum(alpha[-1][:, :, None] + moves, 1))
    beta = [np.zeros_like(alpha[0])]
    for t in range(steps - 1, 0, -1):
        beta.append(_log_sum(moves + (scores[t] + beta[-1])[:, None, :], 2))
    beta = beta[::-1]
    total = _log_sum(alpha[-1], 1)
    chances = np.exp(np.stack(alpha) + np.stack(beta) - total[:, None])
    moved = np.zeros_like(moves)
    for t in range(1, steps):
        joint = alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t])[:, None, :]
        moved += np.exp(joint - total[:, None, None]).sum(axis=0)
    return total, chances, moved


def loss_and_gradient(model: dict, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of tag rows, and its gradient by every parameter."""
    scores, both, traces = emissions(model, codes, keep=True)
    rules = allowed(scores.shape[2])
    moves = model["moves"] + rules
    first = model["first"] + rules[0]
    total, chances, moved = marginals(scores, moves, first)
    rows, steps = np.arange(len(codes)), codes.shape[1]
    gold = first[tags[:, 0]] + scores[0][rows, tags[:, 0]]
    seen = np.zeros_like(moves)
    for t in range(1, steps):
        gold = gold + moves[tags[:, t - 1], tags[:, t]] + scores[t][rows, tags[:, t]]
        np.add.at(seen, (tags[:, t - 1], tags[:, t]), 1)
    d = chances
    for t in range(steps):
        d[t][rows, tags[:, t]] -= 1
    to = {name: np.zeros_like(value) for name, value in model.items()}
    to["moves"] = (moved - seen) * (rules == 0)
    to["first"] = d[0].sum(axis=0) * (rules[0] == 0)
    flat = d.reshape(-1, d.shape[2])
    to["output"] = both.reshape(len(flat), -1).T @ flat
    to["output_bias"] = flat.sum(axis=0)
    dstates = d @ model["output"].T
    n = model["forward_recurrent"].shape[0]
    _lstm_back(model, "forward", codes, traces[0], dstates[:, :, :n], to)
    _lstm_back(model, "backward", codes[:, ::-1], traces[1], dstates[::-1, :, n:], to)
    return float((total - gold).mean()), {k: v / len(codes) for k, v in to.items()}


def fresh(kinds: int, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    tags = 1 + 2 * kinds
    model = {"embedding": rng.normal(0, 0.3, (N_CLASSES, EMBEDDED))}
    for side in ("forward", "backward"):
        model[f"{side}_input"] = rng.normal(0, 0.25, (EMBEDDED, 4 * HIDDEN))
        model[f"{side}_recurrent"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        model[f"{side}_bias"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    model |= {
        "output": rng.normal(0, 0.2, (2 * HIDDEN, tags)),
        "output_bias": np.r_[2.0, np.zeros(tags - 1)],
        "moves": np.zeros((tags, tags)),
        "first": np.zeros(tags),
    }
    return model


def tag_rows(spans: Sequence[Sequence[tuple[int, int, int]]], width: int) -> np.ndarray:
    tags = np.zeros((len(spans), width), np.int64)
    for row, found in zip(tags, spans):
        for kind, start, end in found:
            row[start:end] = 2 + 2 * kind
            row[start] = 1 + 2 * kind
    return tags


def decode(model: dict, codes: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """The spans of each row's best tags (Viterbi): kind, start, end, weight.

    The weight is the sum over the span of how far its kind's probability exceeds one half.
    """
    scores, _, _ = emissions(model, codes)
    steps, rows, tags = scores.shape
    rules = allowed(tags)
    moves, first = model["moves"] + rules, model["first"] + rules[0]
    best, back = scores[0] + first, []
    for t in range(1, steps):
        ways = best[:, :, None] + moves
        back.append(ways.argmax(axis=1))
        best = scores[t] + ways.max(axis=1)
    path = np.zeros((rows, steps), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t - 1][np.arange(rows), path[:, t]]
    some = np.flatnonzero(path.any(axis=1))
    out: list[list] = [[] for _ in range(rows)]
    if not len(some):
        return out
    _, chances, _ = marginals(scores[:, some], moves, first)
    for at, row in enumerate(some):
        starts = np.flatnonzero(path[row] % 2 == 1)
        for start in starts:
            kind = (path[row, start] - 1) // 2
            end = start + 1
            while end < steps and path[row, end] == 2 + 2 * kind:
                end += 1
            sure = chances[start:end, at, 1 + 2 * kind] + chances[start:end, at, 2 + 2 * kind]
            out[row].append((int(kind), int(start), int(end), float((sure - 0.5).sum())))
    return out


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(string.digits) for _ in range(n))


def _letters(rng: random.Random, low: int, high: int) -> str:
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(low, high)))


def _grouped(rng: random.Random, digits: str, marks: Sequence[str]) -> str:
    mark = rng.choice(marks)
    return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def invent(kind: str, rng: random.Random) -> str:
    """A string of a kind, in one of the ways in which such data are written."""
    if kind == "email":
        name = _letters(rng, 2, 9)
        if rng.random() < 0.6:
            name += rng.choice("._-+") + rng.choice([_digits(rng, 2), _letters(rng, 2, 7)])
        host = rng.choice([_letters(rng, 3, 9), f"{_letters(rng, 3, 6)}{rng.randint(1, 9)}"])
        at = rng.choice(["@", "@", "@", " @ "])
        return f"{name}{at}{host}.{rng.choice(['com', 'org', 'example.com', 'co.uk', 'net'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return _grouped(rng, rng.choice("3456") + _digits(rng, 15), ["", "", " ", "-"])
    area, office, line = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    ways = ["({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]
    number = rng.choice(ways).format(area, office, line)
    return rng.choice(["", "", "+1 ", "1-", "001 "]) + number


def distract(rng: random.Random) -> str:
    """What looks like personal data and is none."""
    ways = [
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}",
        lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}",
        lambda: str(rng.randint(0, 99999)),
        lambda: f"{rng.randint(1, 999)},{_digits(rng, 3)},{_digits(rng, 3)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40, 64]))),
        lambda: "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)),
        lambda: f"password={_letters(rng, 3, 5)}{_digits(rng, 6)}",
        lambda: f"@{_letters(rng, 3, 8)}",
        lambda: f"{_letters(rng, 2, 4)}{_digits(rng, rng.randint(1, 4))}",
        lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}-rc",
        lambda: _digits(rng, rng.choice([6, 8, 20, 24, 30])),
    ]
    return rng.choice(ways)()


def vary(
    examples: Sequence[tuple[str, list[tuple[int, int, int]]]],
    kinds: Sequence[str],
    width: int,
    most: int,
    rng: random.Random,
) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``most`` examples: real ones, and contexts with invented spans and distractions put in."""
    with_spans = [e for e in examples if e[1]]
    plain = [t for t, spans in examples if not spans] or [
        " ".join(_letters(rng, 2, 9) for _ in range(30)) + "." for _ in range(50)
    ]
    rng.shuffle(with_spans)
    made = with_spans[: most // 3]
    while len(made) < most:
        text, spans = rng.choice(plain), []
        words = text.split(" ")
        at = rng.randint(0, max(0, len(words) - 1))
        parts = [" ".join(words[:at])[-rng.randint(0, 90) :], ""]
        for _ in range(rng.randint(1, 3)):
            label = rng.choice([*kinds, *kinds, None, None, None])
            item = distract(rng) if label is None else invent(label, rng)
            lead = "".join(parts)
            if lead and not lead[-1].isspace():
                lead += rng.choice([" ", " ", " ", "\n", ": ", " ("])
            if label is not None:
                spans.append((kinds.index(label), len(lead), len(lead) + len(item)))
            parts = [lead + item + rng.choice(["", "", "", ",", ".", ")"]), ""]
        made.append(
            (
                (parts[0] + " " + " ".join(words[at:]))[:width],
                [s for s in spans if s[2] <= width],
            )
        )
    # A span that the window cuts off is learned as far as it goes.
    return made


def train(
    examples: Sequence[tuple[str, list[tuple[int, int, int]]]],
    kinds: Sequence[str],
    width: int,
    most: int = 2700,
    passes: int = 7,
    batch: int = 32,
    rate: float = 0.03,
    seed: int = 7,
) -> dict:
    """A model trained by Adam; the same from the same examples."""
    rng = random.Random(seed)
    made = vary(list(examples), kinds, width, most, rng)
    codes = encode([t for t, _ in made], width)
    tags = tag_rows([s for _, s in made], width)
    model = fresh(len(kinds), seed)
    mean = {k: np.zeros_like(v) for k, v in model.items()}
    square = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    steps = passes * -(-len(made) // batch)
    order = list(range(len(made)))
    for _ in range(passes):
        rng.shuffle(order)
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            _, gradient = loss_and_gradient(model, codes[rows], tags[rows])
            norm = np.sqrt(sum((g**2).sum() for g in gradient.values()))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for name, g in gradient.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.99 * square[name] + 0.01 * g**2
                unbiased = mean[name] / (1 - 0.9**step)
                spread = np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8
                model[name] = model[name] - now * unbiased / spread
    return model
