"""File blocks, directives and stop markers in texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions import rules
from mnemora.functions.arrays import indexes, let
from mnemora.functions.text import strip

_BLOCK = "(?U)" + rules.FILE_BLOCK


def file_blocks(text: Column) -> Column:
    """All blocks in order, ``array<struct<filename, content>>``."""
    names = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(2))
    return F.zip_with(names, bodies, lambda n, b: F.struct(strip(n).alias("filename"), b.alias("content")))


def file_map(text: Column) -> Column:
    """filename -> content; the last block of a name wins (needs LAST_WIN key handling)."""
    return let(
        file_blocks(text),
        lambda b: F.map_from_arrays(F.transform(b, lambda x: x["filename"]), F.transform(b, lambda x: x["content"])),
    )


def without_blocks(text: Column) -> Column:
    """The text without canonical blocks, with long blank gaps closed; unchanged when it has none."""

    def clean(blocks: Column) -> Column:
        bare = F.aggregate(
            blocks,
            text,
            lambda acc, b: F.replace(
                acc,
                F.concat(F.lit(">>> FILE: "), b["filename"], F.lit("\n"), b["content"], F.lit("\n<<<")),
                F.lit(""),
            ),
        )
        return F.when(F.size(blocks) == 0, text).otherwise(strip(F.regexp_replace(bare, "\n{3,}", "\n\n")))

    return let(file_blocks(text), clean)


def command_lines(text: Column) -> Column:
    """``struct<kept, commands>``: lines outside and inside file blocks; an open block runs to the end.

    A line belongs to a block when the nearest marker at or before it opens one; the
    closing line belongs to the block it ends.
    """

    def divide(lines: Column) -> Column:
        # 1 opens, -1 closes, 0 leaves the state alone
        marks = F.transform(
            lines,
            lambda ln: F.when(F.contains(ln, F.lit(">>>")) & F.contains(ln, F.lit("FILE:")), 1)
            .when(F.contains(ln, F.lit("<<<")), -1)
            .otherwise(0),
        )
        return let(
            marks,
            lambda m: let(
                F.filter(indexes(F.size(m)), lambda i: F.get(m, i) != 0),
                lambda at: let(
                    # the mark in force after each line: zeros up to the first marker, then one stretch per marker
                    F.concat(
                        F.array_repeat(F.lit(0), F.coalesce(F.get(at, F.lit(0)), F.size(m))),
                        F.flatten(
                            F.transform(
                                at,
                                lambda p, j: F.array_repeat(F.get(m, p), F.coalesce(F.get(at, j + 1), F.size(m)) - p),
                            )
                        ),
                    ),
                    lambda after: let(
                        F.transform(
                            m,
                            lambda k, i: (F.get(after, i) == 1)
                            | ((k == -1) & F.coalesce(F.get(after, i - 1) == 1, F.lit(False))),
                        ),
                        lambda inside: F.struct(
                            F.array_join(F.filter(lines, lambda ln, i: ~F.get(inside, i)), "\n").alias("kept"),
                            F.filter(lines, lambda ln, i: F.get(inside, i)).alias("commands"),
                        ),
                    ),
                ),
            ),
        )

    return let(F.split(text, "\n"), divide)


def without_commands(text: Column) -> Column:
    """Text left after :func:`command_lines`, unchanged when there is no command."""
    return let(command_lines(text), lambda c: F.when(F.size(c["commands"]) > 0, c["kept"]).otherwise(text))


def save_directives(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rules.SAVE_DIRECTIVE), F.lit(1))


def shell_directives(text: Column) -> Column:
    """Shell directives are data here: they are extracted and never run."""
    return F.regexp_extract_all(text, F.lit(rules.SHELL_DIRECTIVE), F.lit(1))


def without_directives(text: Column) -> Column:
    saved = F.regexp_replace(text, rules.SAVE_DIRECTIVE, "")
    return strip(F.regexp_replace(saved, rules.SHELL_DIRECTIVE, rules.SHELL_DISABLED))


def safe_filename(name: Column) -> Column:
    """A flat file name; separators and reserved characters become ``_``, ``.`` and ``..`` are refused.

    Replacing the separators first means only an empty name is left to normalise, to ``.``.
    """
    flat = F.regexp_replace(name, rules.UNSAFE_FILENAME, "_")
    return F.when(flat.isin("", ".", ".."), F.lit(None)).otherwise(flat)


def before_stop_marker(text: Column) -> Column:
    """Text before the first user or assistant marker, tested in that order."""
    out = text
    for marker in rules.STOP_MARKERS:
        out = F.substring_index(out, marker, 1)
    return out
