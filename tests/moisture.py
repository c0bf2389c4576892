"""Plain-Python moisture codes, written from the published equations, for comparison."""

import math

L = [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0]
DRY = [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]


def step(t, h, w, r, month, f, p, d):
    m = 147.2 * (101 - f) / (59.5 + f)
    if r > 0.5:
        n = r - 0.5
        got = m + 42.5 * n * math.exp(-100 / max(251 - m, 1)) * (1 - math.exp(-6.93 / n))
        if m > 150:
            got += 0.0015 * (m - 150) ** 2 * math.sqrt(n)
        m = min(got, 250)
    x = 0.18 * (21.1 - t) * (1 - math.exp(-0.115 * h))
    ed = 0.942 * h**0.679 + 11 * math.exp((h - 100) / 10) + x
    ew = 0.618 * h**0.753 + 10 * math.exp((h - 100) / 10) + x

    def k(s):
        return (0.424 * (1 - s**1.7) + 0.0694 * math.sqrt(w) * (1 - s**8)) * 0.581 * math.exp(0.0365 * t)

    if m > ed:
        m = ed + (m - ed) * 10 ** -k(h / 100)
    elif m < ew:
        m = ew - (ew - m) * 10 ** -k((100 - h) / 100)
    f = min(max(59.5 * (250 - m) / (147.2 + m), 0), 101)
    tp = -1.1 if t < 1.1 else t
    if r > 1.5:
        b = 100 / (0.5 + 0.3 * p) if p <= 33 else 14 - 1.3 * math.log(p) if p <= 65 else 6.2 * math.log(p) - 17.2
        rw = 0.92 * r - 1.27
        mr = 20 + math.exp(5.6348 - p / 43.43) + 1000 * rw / (48.77 + b * rw)
        p = max(0, 244.72 - 43.43 * math.log(max(mr - 20, 1e-10)))
    p = max(p + 100 * 1.894 * (tp + 1.1) * (100 - h) * L[month - 1] * 1e-6, 0)
    td = -2.8 if t < 2.8 else t
    if r > 2.8:
        d = max(0, 400 * math.log(800 / max(800 * math.exp(-d / 400) + 3.937 * (0.83 * r - 1.27), 1e-10)))
    d = max(d + 0.5 * max(0.36 * (td + 2.8) + DRY[month - 1], 0), 0)
    return f, p, d
