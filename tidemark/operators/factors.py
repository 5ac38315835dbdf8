"""Cholesky factors in blocks, in memory or in a temporary file of their task."""

from __future__ import annotations

import tempfile

import numpy as np

#: Rows and columns of a block, and the bytes from which a factor lies in a file.
BLOCK, HELD = 512, 1 << 28


class Factor:
    """A symmetric matrix that is filled row by row and then factored in place; only a block column is held besides it.

    The file has no name, goes with its task, and is made again where a lost task runs again.
    """

    def __init__(self, n: int):
        self.n, self.back = n, []
        self.low = np.memmap(tempfile.TemporaryFile(), np.float64, "w+", shape=(n, n)) if n * n * 8 > HELD else np.zeros((n, n))

    def factor(self) -> None:
        """Turns the lower triangle into the factor; LinAlgError where the matrix isn't positive definite."""
        for j in range(0, self.n, BLOCK):
            e = min(j + BLOCK, self.n)
            done = np.array(self.low[j:e, :j])
            top = np.linalg.cholesky(self.low[j:e, j:e] - done @ done.T)
            self.back.append(np.linalg.solve(top, np.eye(e - j)))
            self.low[j:e, j:e] = top
            for i in range(e, self.n, BLOCK):
                f = min(i + BLOCK, self.n)
                self.low[i:f, j:e] = (self.low[i:f, j:e] - self.low[i:f, :j] @ done.T) @ self.back[-1].T

    def forward(self, right: np.ndarray, n: int) -> np.ndarray:
        """The leading n rows of the factor's inverse times right, whose first n rows are read."""
        out = np.zeros((n, right.shape[1]))
        for k, j in enumerate(range(0, n, BLOCK)):
            e, whole = min(j + BLOCK, n), min(j + BLOCK, self.n)
            part = np.zeros((whole - j, right.shape[1]))
            part[: e - j] = right[j:e] - self.low[j:e, :j] @ out[:j]
            out[j:e] = (self.back[k] @ part)[: e - j]
        return out

    def log_determinant(self) -> float:
        """That of the matrix."""
        return 2 * float(np.log(np.diagonal(self.low)).sum())
