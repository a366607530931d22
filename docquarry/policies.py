"""Row access as views: what a session's user may read of a table, for Python and SQL alike.

A policy names a table's readers and the rows that each may read. protect() makes a view that applies the policy of the user that a session variable, or current_user(), names, so that queries by that view's name are filtered
before anything else happens to the rows. The table's own path is for the owner; who may read files is a matter of the storage. A user without a policy reads nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The session variable that names the user.
VARIABLE = "docquarry_user"
_NAME = re.compile(r"\w+")
#: Set in a session once the variable is declared.
_DECLARED = "spark.docquarry.user.declared"


def act_as(spark: SparkSession, user: str) -> None:
    """Name the session's user."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING")
    spark.sql(f"SET VAR {VARIABLE} = :user", args={"user": user})
    spark.conf.set(_DECLARED, "true")


def protect(spark: SparkSession, rows: DataFrame, view: str, policies: dict[str, str], variable: bool = True) -> None:
    """Make a view of rows under a policy: the condition (SQL over the rows' columns) of each user; "*" is for users without one of their own.

    variable: take the user from the session variable, which a query reads anew each time; else from current_user(). Null conditions hide a row.
    """
    if not _NAME.fullmatch(view):
        raise ValueError(f"not a name: {view!r}")
    rows.createOrReplaceTempView(f"{view}_rows")
    user = VARIABLE if variable else "current_user()"
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cases = " ".join(f"WHEN {user} = {quoted(u)} THEN ({condition})" for u, condition in policies.items() if u != "*")
    rest = f"({policies['*']})" if "*" in policies else "false"
    allowed = f"CASE {cases} ELSE {rest} END" if cases else rest
    if variable and not spark.conf.get(_DECLARED, None):
        act_as(spark, "")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT * FROM {view}_rows WHERE {allowed}")

