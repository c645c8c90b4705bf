"""Reverse-mode differentiation over small numpy arrays: each operation notes how its gradient goes back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Repeats of a row up to which `take` adds up gradients of all rows at once.
FEW = 8


class Var:
    """A value, its gradient (once `backward` ran), and the step that sends the gradient to what it was made of."""

    __slots__ = ("grad", "made_of", "send", "value")

    def __init__(self, value: np.ndarray, made_of: tuple[Var, ...] = (), send: Callable[[np.ndarray], tuple] | None = None) -> None:
        value = np.asarray(value)
        self.value, self.made_of, self.send = value if value.dtype.kind == "f" else value.astype(float), made_of, send
        self.grad: np.ndarray | None = None


def _fit(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which its operand was repeated."""
    while grad.ndim > len(shape):
        grad = grad.sum(axis=0)
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and grad.shape[i] != 1)
    return grad.sum(axis=wide, keepdims=True) if wide else grad


def add(a: Var, b: Var) -> Var:
    return Var(a.value + b.value, (a, b), lambda g: (_fit(g, a.value.shape), _fit(g, b.value.shape)))


def mul(a: Var, b: Var) -> Var:
    return Var(a.value * b.value, (a, b), lambda g: (_fit(g * b.value, a.value.shape), _fit(g * a.value, b.value.shape)))


def matmul(a: Var, b: Var) -> Var:
    """Product over the last two axes of arrays of the same number of axes."""
    swap = lambda x: np.swapaxes(x, -1, -2)
    return Var(a.value @ b.value, (a, b), lambda g: (g @ swap(b.value), swap(a.value) @ g))


def project(x: np.ndarray, b: Var) -> Var:
    """`matmul` of a fixed matrix."""
    return Var(x @ b.value, (b,), lambda g: (x.T @ g,))


def reshape(a: Var, *shape: int) -> Var:
    return Var(a.value.reshape(shape), (a,), lambda g: (g.reshape(a.value.shape),))


def transpose(a: Var, *axes: int) -> Var:
    return Var(a.value.transpose(axes), (a,), lambda g: (g.transpose(np.argsort(axes)),))


def beside(*parts: Var) -> Var:
    """Matrices of equal height, one beside the other."""
    ends = np.cumsum([x.value.shape[1] for x in parts])[:-1]
    return Var(np.concatenate([x.value for x in parts], axis=1), parts, lambda g: tuple(np.split(g, ends, axis=1)))


def top(a: Var, n: int) -> Var:
    """The first `n` rows."""

    def send(g: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros_like(a.value)
        out[:n] = g
        return (out,)

    return Var(a.value[:n], (a,), send)


def take(a: Var, at: np.ndarray) -> Var:
    """The rows of `a` at `at`, which may repeat."""

    def send(g: np.ndarray) -> tuple[np.ndarray]:
        g, rows = g.reshape(-1, a.value.shape[-1]), at.ravel()
        out, order = np.zeros_like(a.value), np.argsort(rows, kind="stable")
        size = np.bincount(rows, minlength=len(out))
        first = np.cumsum(size) - size
        for r in np.flatnonzero(size > FEW):
            np.add.reduce(g[order[first[r] : first[r] + size[r]]], axis=0, out=out[r])
        rest = np.flatnonzero(size <= FEW)
        for k in range(FEW):
            rest = rest[size[rest] > k]
            out[rest] += g[order[first[rest] + k]]
        return (out,)

    return Var(a.value[at], (a,), send)


def relu(a: Var) -> Var:
    return Var(np.maximum(a.value, 0), (a,), lambda g: (g * (a.value > 0),))


def tanh(a: Var) -> Var:
    t = np.tanh(a.value)
    return Var(t, (a,), lambda g: (g * (1 - t**2),))


def gelu(a: Var) -> Var:
    """In its tanh form."""
    x, c = a.value, float(np.sqrt(2 / np.pi))
    square = x * x
    t = np.tanh(x * (c + c * 0.044715 * square))
    half = 0.5 * (1 + t)

    def send(g: np.ndarray) -> tuple[np.ndarray]:
        slope = 1 - t * t
        slope *= 0.5 * x
        slope *= c + 3 * c * 0.044715 * square
        slope += half
        slope *= g
        return (slope,)

    return Var(x * half, (a,), send)


def softmax(a: Var) -> Var:
    e = np.exp(a.value - a.value.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    return Var(p, (a,), lambda g: (p * (g - (g * p).sum(axis=-1, keepdims=True)),))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the vectors along the last axis."""
    return np.einsum("...i,...i->...", a, b)


def normalise(a: Var, eps: float = 1e-5) -> Var:
    """Rows of mean 0 and variance 1."""
    n = a.value.shape[-1]
    even = np.full(n, 1 / n, a.value.dtype)
    y = a.value - (a.value @ even)[..., None]
    inv = (1 / np.sqrt(_dots(y, y) / n + eps))[..., None]
    y *= inv
    return Var(y, (a,), lambda g: (inv * (g - (g @ even)[..., None] - y * (_dots(g, y) / n)[..., None]),))


def attention(a: Var, there: np.ndarray, heads: int) -> Var:
    """Scaled dot-product attention among the items of each row of `there` (rows x places), added to them: `a` has the items, their queries, keys and values beside one another, one item after the other."""
    (rows, places), kind = there.shape, a.value.dtype
    size = a.value.shape[1] // 4
    d = size // heads
    scale, whole = kind.type(1 / np.sqrt(d)), bool(there.all())

    def spread(x: np.ndarray) -> np.ndarray:
        """Items x (heads x d) as rows x heads x places x d, 0 where there is no item."""
        if whole:
            out = x.reshape(rows, places, heads, -1)
        else:
            out = np.zeros((rows, places, heads, x.shape[1] // heads), kind)
            out[there] = x.reshape(len(x), heads, -1)
        return out.transpose(0, 2, 1, 3)

    def packed(x: np.ndarray) -> np.ndarray:
        x = x.transpose(0, 2, 1, 3)
        return (x.reshape(rows * places, -1) if whole else x[there].reshape(len(a.value), -1)).reshape(len(a.value), -1)

    swap = lambda x: np.swapaxes(x, -1, -2)
    q, k, v = spread(a.value[:, size : 2 * size] * scale), spread(a.value[:, 2 * size : 3 * size]), spread(a.value[:, 3 * size :])
    p = q @ swap(k)
    if not whole:
        p += np.where(there, 0, -1e9).astype(kind)[:, None, None, :]
    p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    p /= (p @ np.ones(places, kind))[..., None]
    mixed = packed(p @ v)

    def send(g: np.ndarray) -> tuple[np.ndarray]:
        near = spread(g)
        back = near @ swap(v)
        back -= spread(_dots(g.reshape(-1, heads, d), mixed.reshape(-1, heads, d)))  # what the shares of an item change in sum
        back *= p
        out = np.empty_like(a.value)
        out[:, :size] = g
        np.multiply(packed(back @ k), scale, out=out[:, size : 2 * size])
        out[:, 2 * size : 3 * size] = packed(swap(back) @ q)
        out[:, 3 * size :] = packed(swap(p) @ near)
        return (out,)

    return Var(a.value[:, :size] + mixed, (a,), send)


def pooled(z: Var, say: Var, size: np.ndarray) -> Var:
    """The mean of each run of `size` rows of `z` (1 at least), weighted by the softmax of what the rows `say` (one column)."""
    first, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    s = say.value[:, 0]
    e = np.exp(s - np.maximum.reduceat(s, first)[of])
    share = e / np.add.reduceat(e, first)[of]

    def send(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = g[of]
        back = _dots(own, z.value)
        return share[:, None] * own, (share * (back - np.add.reduceat(share * back, first)[of]))[:, None]

    return Var(np.add.reduceat(share[:, None] * z.value, first, axis=0), (z, say), send)


def backward(end: Var, grad: np.ndarray) -> None:
    """Fills in the gradients of everything `end` was made of."""
    order, seen, open_ = [], set(), [(end, False)]
    while open_:
        v, ready = open_.pop()
        if ready:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            open_.append((v, True))
            open_ += [(x, False) for x in v.made_of]
    end.grad = grad
    for v in reversed(order):
        if v.send is not None and v.grad is not None:
            for x, g in zip(v.made_of, v.send(v.grad), strict=True):
                x.grad = g if x.grad is None else x.grad + g
