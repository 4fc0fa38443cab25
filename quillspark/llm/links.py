"""Exact links between a few sets: a block's token-group matrix, and who links with whom.

A block of sets is cut into groups of GROUP neighbours by their least token, which similar sets
tend to share. The matrix holds, for every token of the block, which groups' unions have it. A
query's tokens, looked up once, bound its overlap with each group; groups whose bound cannot reach
the needed overlap with a member of fitting size stay closed, and only members of opened groups are
counted exactly: tokens that many members hold as bits, the others by lists of holders. No row is
made for a pair: a task yields two numbers and a local root for each set that has a link.

Sets that are much alike may be given by their difference from a common core, any set C: of the set
A the tokens that A and C don't share, among them `lost` ones of C. Two sets then have
|C| - lost - lost' + d tokens in common, d of them in both differences, so that they link when
(100 + SIMILAR) d >= apart + apart' - limit. Without a core the difference is the set itself. Pairs
for which the right side is not positive link whatever d is; they are left to whoever made the core.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Similarity in hundredths; all bounds are derived from it.
SIMILAR = 75
#: Sets of a group in a block.
GROUP = 32


def apart(n, lost):
    """How far a set of n tokens, without `lost` tokens of the core, is from it."""
    return SIMILAR * n + (100 + SIMILAR) * lost


def limit(core):
    """Sets that are apart by no more than this together link, as the core has that many tokens."""
    return (100 + SIMILAR) * core


class Block:
    """Sets by their tokens, or by those that differ from a core, in groups."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None, lost: np.ndarray | None = None, core: int = 0) -> None:
        self.n = len(sets)
        given = np.array([len(s) for s in sets])
        self.sizes = given if sizes is None else sizes
        self.lost = np.zeros(self.n, np.int64) if lost is None else lost
        self.apart, self.limit = apart(self.sizes, self.lost), limit(core)
        owner = np.repeat(np.arange(self.n), given)
        self.tokens, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self._matrix(np.argsort([s[0] for s in sets], kind="stable"), owner, at)
        often = held * 64 > self.n
        # Common tokens are columns of bits, a row for each set.
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.bits = np.zeros((self.n, -(-int(often.sum()) // 64)), np.uint64)
        col, mine = self.column[at], often[at]
        np.bitwise_or.at(self.bits, (owner[mine], col[mine] >> 6), np.uint64(1) << (col[mine] & 63).astype(np.uint64))
        # The others are lists of holders.
        order = np.argsort(at[~mine], kind="stable")
        self.holder = owner[~mine][order]
        self.count = np.where(often, 0, held)
        self.start = np.cumsum(self.count) - self.count

    def _matrix(self, order: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        """Which groups' unions hold each token, a bit for each group; and the groups' sizes."""
        self.group = np.empty(self.n, np.int64)
        self.group[order] = np.arange(self.n) // GROUP
        groups = int(self.group.max()) + 1
        self.union = np.zeros((len(self.tokens), -(-groups // 8)), np.uint8)
        g = self.group[owner]
        np.bitwise_or.at(self.union, (at, g >> 3), (128 >> (g & 7)).astype(np.uint8))
        self.groups = groups
        self.least, self.most = np.full(groups, np.iinfo(np.int64).max), np.zeros(groups, np.int64)
        np.minimum.at(self.least, self.group, self.sizes)
        np.maximum.at(self.most, self.group, self.sizes)
        self.least_lost, self.farthest = np.full(groups, np.iinfo(np.int64).max), np.zeros(groups, np.int64)
        np.minimum.at(self.least_lost, self.group, self.lost)
        np.maximum.at(self.farthest, self.group, self.apart)

    def opened(self, at: np.ndarray, n: int, lost: int) -> np.ndarray:
        """The groups that the bound leaves open to a set of n tokens; `at`: where the block has
        those that it is given by."""
        overlap = np.unpackbits(self.union[at], axis=1, count=self.groups).sum(axis=0, dtype=np.int64)
        smallest = np.maximum(self.least, -(-SIMILAR * n // 100))
        own = apart(n, lost) - self.limit
        bound = (100 + SIMILAR) * overlap >= own + apart(smallest, self.least_lost)
        return bound & (own + self.farthest > 0) & (smallest <= self.most) & (self.least * SIMILAR <= n * 100)

    def near(self, tokens: np.ndarray, n: int | None = None, lost: int = 0) -> np.ndarray:
        """Places of the sets that link with one of n tokens, given by these, because of what the
        block's sets are given by: pairs that the core alone links are not among them."""
        n = len(tokens) if n is None else n
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        rows = np.flatnonzero(self.opened(at, n, lost)[self.group]) if len(at) else at
        if not len(rows):
            return rows
        col = self.column[at]
        col = col[col >= 0]
        asked = np.zeros(self.bits.shape[1], np.uint64)
        np.bitwise_or.at(asked, col >> 6, np.uint64(1) << (col & 63).astype(np.uint64))
        common = np.bitwise_count(self.bits[rows] & asked).sum(axis=1, dtype=np.int64)
        rare = at[self.count[at] > 0]
        if len(rare):
            held = self.count[rare]
            places = np.repeat(self.start[rare] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            common += np.bincount(self.holder[places], minlength=self.n)[rows]
        missing = apart(n, lost) + self.apart[rows] - self.limit
        return rows[(missing > 0) & ((100 + SIMILAR) * common >= missing)]


def count_links(table: pa.Table) -> pa.Table:
    """class, links, documents, root of each class that links within this table: `asks` rows look
    for links among `member` rows; a pair that only one side asks for counts for both. Rows have n
    tokens each and are given by `tokens`, `lost` and the number of tokens of one `core`."""
    name, copies, sizes, lost = (table[c].to_numpy().astype(np.int64) for c in ("class", "class_size", "n", "lost"))
    asks, member = np.array(table["asks"].to_pylist(), bool), np.array(table["member"].to_pylist(), bool)
    sets = [x.values.to_numpy().view(np.uint64) for x in table["tokens"]]
    links, reached = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    root = np.arange(len(sets))
    members = np.flatnonzero(member)
    if len(members) and asks.any():
        block = Block([sets[k] for k in members], sizes[members], lost[members], table["core"][0].as_py())
        for i in np.flatnonzero(asks).tolist():
            near = members[block.near(sets[i], sizes[i], lost[i])]
            near = near[near != i]
            links[i] += len(near)
            reached[i] += copies[near].sum()
            passive = near[~asks[near]]
            links[passive] += 1
            reached[passive] += copies[i]
            for other in np.unique(root[near][root[near] != root[i]]).tolist():
                root[root == other] = root[i]
    found = np.flatnonzero(links)
    return pa.table({"class": name[found], "links": links[found], "documents": reached[found], "root": name[root[found]]})
