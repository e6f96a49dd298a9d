"""Layout labels and what they mean for the order and the rendering of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normalized labels of each role.
ROLES = {
    "header": ["page_header", "header", "running_header"],
    "footer": ["page_footer", "footer", "running_footer"],
    "footnote": ["footnote"],
    "caption": ["caption"],
    "float": ["table", "picture", "figure", "image", "chart", "graphic"],
}
#: Roles that are furniture of the page, not of its text.
FURNITURE = ("header", "footer", "footnote")


def normalize(label: Column) -> Column:
    """Lower case with underscores for what is no letter or digit; null gives empty text."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(label)), r"[^\p{L}\p{N}]", "_"), F.lit(""))


def role(label: Column) -> Column:
    norm, found = normalize(label), None
    for name, members in ROLES.items():
        found = F.when(norm.isin(members), name) if found is None else found.when(norm.isin(members), name)
    return found.otherwise("body")


def kind(label: Column) -> Column:
    """Letters and digits of a label in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}\p{N}]", "")


def placeholder(label: Column) -> Column:
    """What stands for an element without text."""
    return F.concat(F.lit("<["), F.upper(label), F.lit("]>"))
