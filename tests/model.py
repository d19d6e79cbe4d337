"""A plain list model of the index, in 32-bit floats."""

import math

import numpy as np

f = np.float32


def dist(p, q):
    dx, dy, dz = (f(a) - f(b) for a, b in zip(p, q, strict=True))
    return f(f(f(dx * dx) + f(dy * dy)) + f(dz * dz))


def key(p, size):
    return tuple(math.floor(f(f(v) / f(size))) for v in p)


def centre(p, size):
    out = []
    for v in p:
        low = f(f(math.floor(f(f(v) / f(size)))) * f(size))
        high = f(low + f(size))
        out.append(f(float(low) + float(f(high - low)) / 2.0))
    return out


class Model:
    def __init__(self):
        self.points = {}  # id -> [x, y, z, status]

    def build(self, rows):
        self.points = {i: [*map(f, p), "LIVE"] for i, p in rows}

    def live(self):
        return {i: p[:3] for i, p in self.points.items() if p[3] == "LIVE"}

    def add(self, rows):
        for i, p in rows:
            self.points[i] = [*map(f, p), "LIVE"]

    def inside(self, p, low, high):
        return all(f(lo) <= v < f(hi) for v, lo, hi in zip(p, low, high, strict=True))

    def change_boxes(self, boxes, was, becomes):
        n = 0
        for p in self.points.values():
            if p[3] == was and any(self.inside(p[:3], *b) for b in boxes):
                p[3] = becomes
                n += 1
        return n

    def delete(self, requests):
        rest = []
        for _, q in requests:
            same = sorted(i for i, p in self.live().items() if all(a == f(b) for a, b in zip(p, q, strict=True)))
            if same:
                self.points[same[0]][3] = "DELETED"
            else:
                rest.append(q)
        for q in rest:
            near = sorted(i for i, p in self.live().items() if all(float(abs(f(a - f(b)))) < 1e-6 for a, b in zip(p, q, strict=True)))
            if near:
                self.points[near[0]][3] = "DELETED"

    def add_thinned(self, rows, size):
        """One arrival after the other, as the rules say; returns how many counted."""
        n = 0
        mine = set()
        for i, p in rows:
            p = [*map(f, p)]
            here = [j for j, q in self.live().items() if key(q, size) == key(p, size)]
            c = centre(p, size)
            best, at = dist(p, c), None
            for j in sorted(here):
                if dist(self.points[j][:3], c) < best:
                    best, at = dist(self.points[j][:3], c), j
            twin = at is not None and all(float(abs(f(a - b))) < 1e-6 for a, b in zip(self.points[at][:3], p, strict=True))
            if len(here) > 1 or at is None or twin:
                n += 1
                for j in here:
                    self.points[j][3] = "DOWNSAMPLED"
                if at is None:
                    self.points[i] = [*p, "LIVE"]
                    mine.add(i)
                else:
                    self.points[at][3] = "LIVE"
        for j in [j for j in mine if self.points[j][3] == "DOWNSAMPLED"]:
            del self.points[j]
        return n

    def nearest(self, q, k, cap=math.inf):
        found = sorted((dist(p, q), *p, i) for i, p in self.live().items())
        return [(float(d), i) for d, *_, i in found if float(d) <= cap * cap][:k]

    def compact(self):
        gone = sorted(i for i, p in self.points.items() if p[3] == "DELETED")
        self.points = {i: p for i, p in self.points.items() if p[3] == "LIVE"}
        return gone
