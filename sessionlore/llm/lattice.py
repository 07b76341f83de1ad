"""Subword lattices of words: all segmentations into pieces of a vocabulary, weighted by unigram scores."""

from __future__ import annotations

import numpy as np

from sessionlore.llm.texts import PairTable

MARK = "▁"


def vocabulary(content: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, their log probabilities from the ranks that the file gives as scores, and the pieces of the 256 bytes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    pieces = pb.ModelProto.FromString(content).pieces
    score = np.array([p.score for p in pieces])
    order = np.argsort(-score, kind="stable")
    weight = np.empty(len(pieces))
    weight[order] = 1.0 / (np.arange(len(pieces)) + 2.0)  # frequency falls with the rank
    used = np.array([p.type in (1, 6) for p in pieces])
    weight[~used] = 0
    byte = np.zeros(256, np.int64)
    for i, p in enumerate(pieces):
        if p.type == 6:
            byte[int(p.piece[1:-1], 16)] = i
    weight[byte] = weight[used & (weight > 0)].min()
    names = [p.piece if p.type == 1 else "" for p in pieces]
    with np.errstate(divide="ignore"):
        return names, np.log(weight / weight.sum()), byte


class Lattice:
    def __init__(self, pieces: list[str], byte: np.ndarray, logs: np.ndarray):
        self.byte, self.logs = byte, logs
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                at = nodes.setdefault((at, ord(c)), len(ends))
                if at == len(ends):
                    ends.append(-1)
            if p:
                ends[at] = i
        self.piece = np.array(ends, np.int64)
        keys = np.array([a << 21 | c for a, c in nodes], np.int64)
        self.table = PairTable(4 * len(keys))
        self.table.add(keys, np.fromiter(nodes.values(), np.int64, len(nodes)))

    def arcs(self, words: list[str]):
        """Arcs of all words: first and last place, piece; and the places of the words, one more than characters."""
        codes = np.frombuffer("".join(f"{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(size + 1) - size - 1
        inside = np.ones(len(codes), bool)
        inside[base + size] = False
        at = np.flatnonzero(inside)
        node, length = np.zeros(len(at), np.int64), 0
        begins, ends, pieces, alone = [], [], [], np.ones(len(codes), bool)
        while len(at):
            node = self.table.get(node << 21 | codes[at + length])
            length += 1
            at, node = at[node >= 0], node[node >= 0]
            hit = self.piece[node] >= 0
            begins.append(at[hit])
            ends.append(at[hit] + length)
            pieces.append(self.piece[node[hit]])
            if length == 1:
                alone[at[hit]] = False
            more = inside[at + length]
            at, node = at[more], node[more]
        # A character that is no piece is read as its bytes: one arc with their joint weight.
        other = np.flatnonzero(alone & inside)
        begins.append(other)
        ends.append(other + 1)
        pieces.append(-1 - codes[other])
        return np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces), base, size

    def _weights(self, pieces: np.ndarray) -> np.ndarray:
        out = self.logs[np.maximum(pieces, 0)]
        for i in np.flatnonzero(pieces < 0).tolist():
            out[i] = self.logs[self.byte[list(chr(-1 - pieces[i]).encode("utf-8", "surrogatepass"))]].sum()
        return out

    @staticmethod
    def _turns(key: np.ndarray, length: np.ndarray, most: int):
        """Groups of arcs that no two of one word share a place in, in the order of ``key``."""
        order = np.lexsort((length, key))
        rank = key[order] * most + length[order]
        cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
        return order, cut.tolist() + [len(order)]

    def forward(self, words: list[str], counts: np.ndarray | None = None):
        """Log probability of each word over all its segmentations; with ``counts``, the expected pieces too."""
        begin, end, piece, base, size = self.arcs(words)
        weight = self._weights(piece)
        n = int(base[-1] + size[-1] + 1) if len(words) else 0
        start = np.repeat(base, size + 1)
        length, most = end - begin, int((end - begin).max(initial=0)) + 1
        alpha = np.full(n, -np.inf)
        alpha[base] = 0.0
        order, cut = self._turns(begin - start[begin], length, most)
        b, e, w = begin[order], end[order], weight[order]
        for i, j in zip(cut, cut[1:]):
            alpha[e[i:j]] = np.logaddexp(alpha[e[i:j]], alpha[b[i:j]] + w[i:j])
        total = alpha[base + size]
        if counts is None:
            return total
        last = np.repeat(base + size, size + 1)
        beta = np.full(n, -np.inf)
        beta[base + size] = 0.0
        order, cut = self._turns(last[end] - end, length, most)
        b, e, w = begin[order], end[order], weight[order]
        for i, j in zip(cut, cut[1:]):
            beta[b[i:j]] = np.logaddexp(beta[b[i:j]], beta[e[i:j]] + w[i:j])
        word = np.repeat(np.arange(len(words)), size + 1)[begin]
        share = np.exp(alpha[begin] + weight + beta[end] - total[word]) * counts[word]
        plain = piece >= 0
        found = np.bincount(piece[plain], share[plain], len(self.logs))
        for p, s in zip(piece[~plain].tolist(), share[~plain].tolist()):
            np.add.at(found, self.byte[list(chr(-1 - p).encode("utf-8", "surrogatepass"))], s)
        return total, found
