"""Optimal-string-alignment edit distance (insert, delete, substitute, swap of neighbours)."""

from __future__ import annotations


def osa_table(a: str, b: str) -> str:
    """Exact distance by dynamic programming over two nested folds.

    Interpreted per cell, so use it on pairs that passed a cheap bound (see ``osa``).
    """
    cell = f"""least(
        element_at(rows.prev, j + 1) + 1,
        element_at(cur, -1) + 1,
        element_at(rows.prev, j) + IF(substr({a}, i, 1) = substr({b}, j, 1), 0, 1),
        IF(i > 1 AND j > 1 AND substr({a}, i, 1) = substr({b}, j - 1, 1) AND substr({a}, i - 1, 1) = substr({b}, j, 1),
           element_at(rows.before, greatest(j - 1, 1)) + 1, 1000000))"""
    next_row = f"aggregate(sequence(1, length({b})), array(i), (cur, j) -> concat(cur, array({cell})))"
    first = f"concat(array(0), sequence(1, length({b})))"
    table = f"""aggregate(sequence(1, length({a})), named_struct('before', {first}, 'prev', {first}),
        (rows, i) -> named_struct('before', rows.prev, 'prev', {next_row}), rows -> element_at(rows.prev, -1))"""
    return f"CASE WHEN length({a}) = 0 THEN length({b}) WHEN length({b}) = 0 THEN length({a}) ELSE {table} END"


def swapped_pairs(text: str) -> list[str]:
    """Neighbouring letters of a known text in reverse order, equal neighbours left out."""
    return sorted({y + x for x, y in zip(text, text[1:], strict=False) if x != y})


def swapped_pairs_of(b: str) -> str:
    """``swapped_pairs`` of a column."""
    pairs = f"transform(sequence(1, length({b}) - 1), p -> concat(substr({b}, p + 1, 1), substr({b}, p, 1)))"
    none = "CAST(array() AS array<string>)"
    return f"filter(IF(length({b}) > 1, {pairs}, {none}), s -> substr(s, 1, 1) <> substr(s, 2, 1))"


def may_swap(a: str, swaps: str) -> str:
    """False only when no swap can take part in an alignment, so that OSA equals Levenshtein."""
    return f"exists({swaps}, s -> contains({a}, s))"


def osa(a: str, b: str, limit: str | None = None) -> str:
    """OSA distance, capped at ``limit`` when given.

    The native Levenshtein distance decides most pairs: it equals OSA unless ``a`` holds two
    neighbouring letters of ``b`` in reverse order.
    """
    lev = f"levenshtein({a}, {b})"
    exact = f"IF({lev} <= 1 OR NOT {may_swap(a, swapped_pairs_of(b))}, {lev}, {osa_table(a, b)})"
    if limit is None:
        return exact
    return f"IF(abs(length({a}) - length({b})) >= {limit}, {limit}, least({exact}, {limit}))"


def osa_within(a: str, b: str, k: str, swaps: str) -> str:
    """Whether the distance is at most ``k``; each test is cheaper than the next.

    A swap is two substitutions, hence Levenshtein <= 2 * OSA, and of k edits all but 2 * k - Levenshtein are swaps at
    least. Swaps change neither length nor letters, so lengths, and the letters of one text that the other lacks, differ
    by no more than the other edits.
    """
    lev = f"levenshtein({a}, {b})"
    others = f"2 * {k} - {lev}"
    lacks = lambda x, y: f"size(array_except(split({x}, ''), split({y}, '')))"
    return (
        f"(abs(length({a}) - length({b})) <= {k} AND ({lev} <= {k} OR "
        f"(abs(length({a}) - length({b})) <= {others} AND {may_swap(a, swaps)} AND {lacks(a, b)} <= {others} AND {lacks(b, a)} <= {others} "
        f"AND {osa_table(a, b)} <= {k})))"
    )
