"""VARIANT objects as rows of (path, value) and back, whatever their depth.

A path is an array of keys, each as JSON writes it (quoted); a value is JSON text, kept as it is. Leaves are all values
that are not objects, and empty objects. Both directions take one pass over an object's leaves: taking apart is a table
function, putting together an expression that compares each path with the one before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from json import JSONDecoder

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Leaves:
    def eval(self, text: str) -> Iterator[tuple[list[str], str]]:
        """Leaves of a JSON text without white space, as `to_json` writes it."""
        end_of = JSONDecoder().raw_decode
        path: list[str] = []
        at, opened = 0, text is not None  # `opened`: a value begins at `at`
        while text is not None:
            if not opened:
                if text[at : at + 1] == "}":
                    at += 1
                    path.pop()
                if at >= len(text) or not path:
                    return
                if text[at] == "}":
                    continue
                at += 1  # a comma; the next key takes the place of the last
                path.pop()
            if opened and text[at] != "{" or text[at : at + 2] == "{}":
                end = end_of(text, at)[1]
                yield list(path), text[at:end]
                at, opened = end, False
                continue
            if opened:
                at += 1
            _, end = end_of(text, at)
            path.append(text[at:end])
            at, opened = end + 1, True


leaves_of = F.udtf(_Leaves, returnType="path array<string>, value string", useArrow=True)


def leaves(documents: DataFrame, name: str) -> DataFrame:
    """A row for each leaf of the VARIANT column `name`: the other columns, `path` and `value`. A null has none."""
    kept = [c for c in documents.columns if c != name]
    texts = documents.select(*kept, F.to_json(name).alias("_text")).filter(F.col("_text").isNotNull())
    return texts.lateralJoin(leaves_of(F.col("_text").outer())).select(*kept, "path", "value")


def rebuilt(found: Column) -> Column:
    """The VARIANT of an array of structs (`path`, `value`), none a prefix of another: keys in order."""
    return F.parse_json(let(F.sort_array(found), _text))


def _text(inner: Column) -> Column:
    def path(i: Column) -> Column:
        return F.coalesce(F.get(inner, i)["path"], F.array().cast("array<string>"))

    def piece(leaf: Column, i: Column) -> Column:
        return let(path(i - 1), lambda before: joined(leaf, i, before))

    def joined(leaf: Column, i: Column, before: Column) -> Column:
        """Objects of the leaf before that end, objects that begin, and the leaf."""
        both = F.zip_with(leaf["path"], before, lambda a, b: F.coalesce(a == b, F.lit(False)))
        shared = (F.array_position(F.concat(both, F.array(F.lit(False))), False) - 1).cast("int")
        depth = F.size(leaf["path"])
        opened = F.transform(F.slice(leaf["path"], shared + 1, F.greatest(F.lit(0), depth - shared)), lambda key: F.concat(key, F.lit(":")))
        ends = F.concat(F.repeat(F.lit("}"), F.size(before) - shared - 1), F.lit(","))
        start = F.when(i > 0, ends).when(depth > 0, "{").otherwise("")
        return F.concat(start, F.array_join(opened, "{"), leaf["value"])

    last = F.size(path(F.size(inner) - 1))
    return F.concat(F.array_join(F.transform(inner, piece), ""), F.repeat(F.lit("}"), last))
