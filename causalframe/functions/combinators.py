"""Reduction of S, K, I terms; a term is a name or a JSON list [function, argument]."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

_TOKEN = re.compile(r'\s*(?:([\[\],])|("(?:[^"\\]|\\.)*"|[^\s\[\],"]+))')


def parse_term(text: str):
    """A name (any JSON scalar) or a pair (function, argument), without recursion; ValueError for anything else."""
    stack: list[list] = [[]]
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not a term at {at}")
        at = m.end()
        if m[1] == "[":
            stack.append([])
        elif m[1] == "]":
            pair = stack.pop()
            if len(pair) != 2 or not stack:
                raise ValueError("a list must be [function, argument]")
            stack[-1].append(tuple(pair))
        elif m[2]:
            stack[-1].append(json.loads(m[2]))
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("not one term")
    return stack[0][0]


def write_term(term) -> str:
    """The term as compact JSON, without recursion."""
    out, todo = [], [term]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += [_Mark("]"), t[1], _Mark(","), t[0], _Mark("[")]
        else:
            out.append(t.text if isinstance(t, _Mark) else json.dumps(t))
    return "".join(out)


class _Mark:
    def __init__(self, text):
        self.text = text


def reduce_term(term, steps: int = 10_000):
    """Normal form by leftmost reduction: I x = x; K x y = x; S x y z = (x z)(y z). What has another head stays applied.

    Terms of any depth. A term that is not done after `steps` reductions gives None.
    """
    left = steps
    todo: list = [("run", term)]
    done: list = []
    while todo:
        what, t = todo.pop()
        if what == "apply":  # t arguments above their head
            args = done[len(done) - t :]
            del done[len(done) - t :]
            out = done.pop()
            for a in args:
                out = (out, a)
            done.append(out)
            continue
        args: list = []  # the last one is the first argument
        while True:
            while isinstance(t, tuple):
                t, arg = t
                args.append(arg)
            used = {"I": 1, "K": 2, "S": 3}.get(t, 0) if isinstance(t, str) else 0
            if not used or len(args) < used:
                break
            if not left:
                return None
            left -= 1
            x = args.pop()
            if used == 1:
                t = x
            elif used == 2:
                args.pop()
                t = x
            else:
                y, z = args.pop(), args.pop()
                args.append((y, z))
                args.append(z)
                t = x
        done.append(t)
        if args:
            todo.append(("apply", len(args)))
            todo += [("run", a) for a in args]  # the first argument is taken first
    return done[0]


@F.pandas_udf(T.StringType())
def reduce_ski(terms: pd.Series) -> pd.Series:
    """Normal forms as JSON. Null for null, for what is no term, and for terms that take more steps than reduce_term's."""

    def one(text):
        if text is None:
            return None
        try:
            found = reduce_term(parse_term(text))
        except ValueError:
            return None
        return None if found is None else write_term(found)

    return terms.map(one)
