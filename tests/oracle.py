"""Brute force over (layer, written_at, lo, hi, value) facts, point by point."""


def at(facts, t, written=None):
    """(present, value) at t."""
    held = [f for f in facts if f[2] <= t < f[3] and (written is None or f[1] <= written)]
    return (True, max(held, key=lambda f: f[0])[4]) if held else (False, None)


def segments(facts, start, end, written=None):
    """Un-merged (start, end, value): split at every bound of every clipped fact."""
    held = [(f[0], f[1], max(f[2], start), min(f[3], end), f[4]) for f in facts if f[3] > start and f[2] < end and (written is None or f[1] <= written)]
    points = sorted({p for f in held for p in f[2:4]})
    out = []
    for a, b in zip(points, points[1:]):
        there, value = at(held, a)
        if there:
            out.append((a, b, value))
    return out


def merge(found):
    out = []
    for a, b, v in found:
        if out and out[-1][1] == a and out[-1][2] == v and type(out[-1][2]) is type(v):
            out[-1] = (out[-1][0], b, v)
        else:
            out.append((a, b, v))
    return out


def stack(rng, layers=8, facts=20):
    """Random layers without overlap inside a layer; small values, so equal neighbours are common."""
    out = []
    for layer in range(rng.randint(1, layers)):
        at = rng.randint(0, 40)
        for _ in range(rng.randint(1, facts)):
            width = rng.randint(1, 20)
            out.append((layer, layer * 10 // 15, at, at + width, rng.choice([-3, -2, -1, 0, 1, 2, 3, None])))
            at += width + rng.choice([0, 0, rng.randint(0, 10)])
    return out
