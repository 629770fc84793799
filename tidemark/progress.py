"""How far the relations of a circuit have come, and how much of their past is still read.

Time is the number of an epoch; -1 stands before the first. A relation has *reached* the
last epoch whose change it has, and all before it. Its past is *settled* up to an epoch if
no reader can tell apart the changes up to there any more, so that they may be one.

Both are found on the driver in one pass over the graph, which holds nodes in an order in
which inputs come first. A node reads its inputs' changes of the epoch it computes next,
``back`` epochs before it as well (1 for a delay), and sums up to the epoch before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

NOTHING = -1


@dataclass(frozen=True)
class Place:
    """A relation's inputs by position, and how many epochs back it reads them."""

    inputs: tuple[int, ...] = ()
    back: int = 0


def advance(epoch: int) -> int:
    """The epoch after one, 0 after nothing."""
    return max(epoch, NOTHING) + 1


def reached(graph: Sequence[Place], sources: Mapping[int, int]) -> list[int]:
    """The epoch that each relation can reach if its sources have reached theirs: the slowest input's."""
    out: list[int] = []
    for at, place in enumerate(graph):
        if any(i >= at for i in place.inputs):
            raise ValueError("inputs come before their readers")
        out.append(min(out[i] for i in place.inputs) if place.inputs else sources.get(at, NOTHING))
    return out


def settled(graph: Sequence[Place], done: Sequence[int], cursors: Mapping[int, int]) -> list[int]:
    """The epoch up to which each relation's changes may be one, -1 if none may.

    ``done`` are the epochs reached, ``cursors`` those at which relations are read from
    outside; an epoch that a reader is yet to compute, or that a cursor stands at, stays.
    """
    needed = [advance(e) for e in done]
    for at, epoch in cursors.items():
        needed[at] = min(needed[at], max(epoch, 0))
    for at, place in enumerate(graph):
        for i in place.inputs:
            needed[i] = min(needed[i], advance(done[at]) - place.back)
    return [max(NOTHING, e - 1) for e in needed]
