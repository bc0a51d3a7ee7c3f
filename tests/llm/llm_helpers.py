from __future__ import annotations

#: Rows that every operator on documents must take: NULLs, blanks, repeats, a long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 !?"), (5, "a"), (None, "some text without an id"),
       (6, "twice the same row"), (6, "twice the same row"), (7, "long " * 30000), (8, "é" * 40000)]
