"""Sets of linked items within a task, and the shallow trees that hold them together; lectern.operators.components joins the trees.

What leaves a task has bounded degree (forest), so no join key of the components' first step is hot.
"""

from __future__ import annotations

import numpy as np

from lectern.operators.components import connected_components

__all__ = ["connected_components", "forest", "linked_sets"]

FAN = 16


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold a set of nodes together: a tree of at most FAN children a node, shallow and without hubs."""
    members = np.sort(members)
    at = np.arange(1, len(members))
    return members[at], members[(at - 1) // FAN]


def linked_sets(count: int, links_of) -> list[np.ndarray]:
    """Sets of two or more of the items 0..count-1 that links hold together.

    links_of(item, open) gives, of the item numbers in open, those that are linked to item. Every item
    is expanded once, against items not reached yet, so no list of pairs is ever held.
    """
    unseen = np.arange(count)
    found = []
    while len(unseen):
        frontier, unseen, group = [int(unseen[0])], unseen[1:], []
        while frontier:
            item = frontier.pop()
            group.append(item)
            if len(unseen):
                hit = links_of(item, unseen)
                if hit.any():
                    frontier.extend(unseen[hit].tolist())
                    unseen = unseen[~hit]
        if len(group) > 1:
            found.append(np.array(group))
    return found
