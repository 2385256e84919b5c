"""Small Python models of the operators."""

from collections import defaultdict


def numbered(rows):
    """(key, order, value) -> (key, order, value, n)."""
    seen = defaultdict(int)
    out = []
    for key, order, value in sorted(rows, key=lambda r: r[1]):
        seen[key] += 1
        out.append((key, order, value, seen[key]))
    return out


def panes(rows, size, slide):
    """(key, order, value) -> {(key, n): values of the pane}."""
    values = defaultdict(list)
    out = {}
    for key, _, value in sorted(rows, key=lambda r: r[1]):
        values[key].append(value)
        n = len(values[key])
        if n % slide == 0:
            out[(key, n)] = values[key][max(0, n - size) :]
    return out
