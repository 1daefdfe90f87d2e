"""Translation of messages that are made of templates: a table of whole messages, lists of parts, patterns with slots.

The catalogue is the caller's: ``exact`` maps a message to its translation, ``patterns`` are (regular expression, template)
in order of precedence, where ``{1}`` in a template is a group as it stands and ``{t1}`` one that is translated itself.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from .text import let

#: What parts the reasons of a message, before patterns are tried, and the items of a list, after them; with what joins them again.
REASONS, ITEMS = ("；", "; "), ("、", ", ")


def translated(text: Column, exact: dict[str, str], patterns: list[tuple[str, str]], depth: int = 2) -> Column:
    """The message in the other language; what no rule knows stays as it is, null stays null.

    A whole message counts first, then its parts by ``REASONS``, then the first pattern that fits, then its parts by
    ``ITEMS``. Slots and parts are translated likewise, ``depth`` levels down; a list of which no part is known is no list.
    """
    table = F.from_json(F.lit(json.dumps(exact)), "map<string,string>")  # one literal, folded by the optimizer

    def one(x: Column, left: int) -> Column:
        known = F.try_element_at(table, x)
        if not left:
            return F.coalesce(known, x)

        def deeper(y: Column) -> Column:
            return let(y, lambda z: one(z, left - 1))

        def parts(by: tuple[str, str]) -> Column:
            own = F.split(x, re.escape(by[0]))
            told = let(F.transform(own, deeper), lambda t: F.when(t != own, F.array_join(t, by[1])))
            return F.when(F.contains(x, F.lit(by[0])), told)

        def filled(pattern: str, template: str) -> Column:
            out = []
            for piece in re.split(r"(\{t?\d\})", template):
                slot = re.fullmatch(r"\{(t?)(\d)\}", piece)
                group = F.regexp_extract(x, pattern, int(slot[2])) if slot else F.lit(piece)
                out.append(deeper(group) if slot and slot[1] else group)
            return F.concat(*out)

        found = F.coalesce(*[F.when(x.rlike(p), filled(p, t)) for p, t in patterns]) if patterns else F.lit(None).cast("string")
        return F.coalesce(known, parts(REASONS), found, parts(ITEMS), x)

    return let(text, lambda x: one(x, depth))
