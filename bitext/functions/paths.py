"""Column functions over project-relative paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitext import constants as K


def extension(path: Column) -> Column:
    """Lower-cased extension of the last component, empty when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)\z", 1))


def media_type(ext: Column) -> Column:
    ext = F.lower(ext)
    return (
        F.when(ext == "pdf", "application/pdf")
        .when(ext.isin("md", "markdown"), "text/markdown")
        .otherwise("text/plain")
    )


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def without_directory(path: Column, directory: Column) -> Column:
    """The path below ``directory``; unchanged when it lies elsewhere."""
    path, prefix = slashes(path), F.concat(slashes(directory), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def stem(path: Column) -> Column:
    """Path without its extension; a leading dot starts a name, not an extension."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", "")


def pair_key(path: Column, directory: Column) -> Column:
    """Key under which an original and its translation meet."""
    return F.lower(
        F.regexp_replace(stem(without_directory(path, directory)), K.LANGUAGE_SUFFIX, "")
    )


def key_title(key: Column) -> Column:
    last = F.element_at(F.split(key, "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) == "", F.lit(K.UNTITLED)).otherwise(last)


def components(path: Column) -> Column:
    return F.filter(F.split(slashes(path), "/"), lambda c: c != "")


def document_folder(original: Column, translation: Column) -> Column:
    """Folder below the root directory: the original's, else the translation's."""
    parts = components(F.coalesce(original, translation, F.lit("")))
    return F.when(
        F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.size(parts) - 2), "/")
    ).otherwise("")


def ancestors(folder: Column) -> Column:
    """Every prefix of a folder path, shortest first; empty for the root."""
    parts = components(folder)
    return F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def parent_folder(folder: Column) -> Column:
    parts = components(folder)
    return F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    ).otherwise("")


def safe_path(path: Column) -> Column:
    """Relative, inside the project, and made of portable component names."""
    path = F.trim(path)
    parts = F.split(path, "/")
    return (
        (path != "")
        & ~F.startswith(path, F.lit("/"))
        & F.forall(
            F.filter(parts, lambda c: c != ""),
            lambda c: ~c.isin(".", "..") & ~F.regexp_like(c, F.lit(K.RESERVED_COMPONENT)),
        )
    )


def sort_name(name: Column) -> Column:
    """Key that orders names as a reader does: case and accents aside, 9 before 10, ñ after n.

    Digit runs lose leading zeros and are prefixed with their length, so that
    longer numbers follow shorter ones; no number is too long.
    """
    # Every character but ñ keeps its base letter only; "n~" sorts after "n" plus any letter.
    base = F.translate(
        F.lower(name), "áàâäãåāéèêëēíìîïīóòôöõōúùûüūçýÿ", "aaaaaaaeeeeeiiiiioooooouuuuucyy"
    )
    base = F.regexp_replace(base, "ñ", "n~")
    runs = F.regexp_extract_all(base, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(
                F.regexp_like(r, F.lit("^[0-9]")),
                F.concat(
                    F.lpad(F.length(_digits(r)).cast("string"), 6, "0"), F.lit("."), _digits(r)
                ),
            ).otherwise(r),
        ),
        "",
    )


def _digits(run: Column) -> Column:
    return F.regexp_replace(run, r"^0+(?=[0-9])", "")
