"""Plain reference forms of the scores, for checking on small inputs."""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    total = len(a) + len(b)
    return 100.0 if total == 0 else (1 - (total - 2 * lcs(a, b)) / total) * 100


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    gap = 1 if both else 0
    nx, ny = len(both) + gap + len(only_x), len(both) + gap + len(only_y)
    percent = lambda d, t: 100.0 if t == 0 else 100 - 100 * d / t
    best = percent(len(only_x) + len(only_y) - 2 * lcs(only_x, only_y), nx + ny)
    if both:
        best = max(best, percent(gap + len(only_x), len(both) + nx), percent(gap + len(only_y), len(both) + ny))
    return best


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    slide = lambda s, t: max(ratio(s, t[max(i, 0): i + len(s)]) for i in range(1 - len(s), len(t)))
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return max(slide(s, t), slide(t, s)) if len(a) == len(b) else slide(s, t)


SCORES = {"ratio": ratio, "token_sort": token_sort, "token_set": token_set, "partial": partial}
