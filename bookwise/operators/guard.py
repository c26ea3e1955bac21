"""Free-form SELECT on scoped views, in a session that holds nothing else."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise import constants as K
from bookwise.context import Scope
from bookwise.operators import views
from bookwise.operators.scope import scoped
from bookwise.operators.validate import statement_reason
from bookwise.sources.tables import Tables


def isolated_session(spark: SparkSession, build: Callable[[SparkSession], dict[str, DataFrame]]) -> SparkSession:
    """A new session whose only names are the views ``build`` makes in it.

    Scoping holds by construction: no unscoped view exists here, and reading files
    by path is off.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in build(session).items():
        df.createOrReplaceTempView(name)
    return session


def scoped_views(t: Tables, who: Scope, as_of=None) -> dict[str, DataFrame]:
    """Everything a free-form statement of this login may read, unevaluated."""

    def mine(df: DataFrame) -> DataFrame:
        return scoped(df, t.customers, who)

    # a rep's small book is cut out before aggregating, a manager's rows after it
    sales = t.invoice_sales if who.sees_all else mine(t.invoice_sales)
    pg12, ltd = views.customer_pg_12m(sales, as_of), views.customer_pg_ltd(sales)
    users = views.erp_user(t.erp_users)
    return {
        "customer": mine(views.customer_all(t.customers, t.salesreps)),
        "sales_line": mine(views.line_view(t.invoice_sales, "sales_line")),
        "open_quote_line": mine(views.line_view(t.open_quotes, "open_quote_line")),
        "open_order_line": mine(views.line_view(t.open_orders, "open_order_line")),
        "cancelled_quote_line": mine(views.line_view(t.cancelled_quotes, "cancelled_quote_line")),
        "customer_pg_12m": mine(pg12),
        "customer_pg_ltd": mine(ltd),
        "customer_vector": mine(views.customer_vector(pg12)),
        "class_pg_penetration": views.class_pg_penetration(t.invoice_sales, t.customers, as_of, who),
        "salesrep": views.salesrep(t.salesreps, t.customers, who),
        "task": views.task(t.activity_trans, t.task_outbox, users, t.customers, who),
    }


def _spark_text(sql: str) -> str:
    """Drop the schema prefix (temp views have none), leaving literals and quoted names alone."""
    quoted = r"""'(?:[^'\\]|\\.|'')*'""" + r'|"(?:[^"\\]|\\.|"")*"'
    prefix = rf"`{K.VIEW_SCHEMA}`\s*\.\s*|\b{K.VIEW_SCHEMA}\s*\.\s*"
    pattern = rf"{quoted}|{prefix}|`[^`]*`"
    dropped = re.compile(rf"^(?:{prefix})$", re.IGNORECASE)
    return re.sub(pattern, lambda m: "" if dropped.match(m[0]) else m[0], sql, flags=re.IGNORECASE)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _names_outside(session: SparkSession, sql: str, views: set[str]) -> str | None:
    """Second barrier: every relation of the parsed plan must be a view or a WITH name."""
    waiting = [session._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    used, named = [], set(views)
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind in ("ScriptTransformation", "PlanWithUnresolvedIdentifier"):
            return kind
        if kind == "UnresolvedRelation":
            used.append(".".join(_items(node.multipartIdentifier())))
        inner = [x for x in _items(node.innerChildren().toSeq()) if hasattr(x, "children")]
        if kind == "UnresolvedWith":
            named |= {x.alias().lower() for x in inner}
        waiting += _items(node.children().toSeq()) + inner + _items(node.subqueries().toSeq())
    return next((name for name in used if name.lower() not in named), None)


@contextmanager
def time_limit(session: SparkSession, seconds: float) -> Iterator[Callable[[], bool]]:
    """Cancel the Spark jobs of the block once it has run for ``seconds``; yields whether that happened.

    Every job the block starts carries a tag of its own. From the limit on jobs of
    that tag are cancelled until the block ends, so none that starts late stays behind.
    """
    context, tag, done, late = session.sparkContext, f"statement-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while True:
                context.cancelJobsWithTag(tag)
                if done.wait(0.1):
                    break

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield late.is_set
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def guarded_select(session: SparkSession, sql: str, max_rows: int = K.SELECT_ROWS, seconds: float = K.SELECT_SECONDS) -> DataFrame:
    """Run one SELECT in an isolated session, 200 rows and 30 seconds at most.

    The statement runs here, inside the guard: its few rows come back as a local
    table. A refused statement, one that fails, at analysis or while it runs, and one
    that takes too long come back as a row with ``error``, not as an exception.
    """

    def failed(text: str) -> DataFrame:
        return session.createDataFrame([(text,)], "error string")

    text = sql.strip().rstrip(";").strip()
    reason = session.range(1).select(statement_reason(F.lit(text))).first()[0]
    if reason is None and re.search(rf"\b({'|'.join(K.FORBIDDEN_SPARK_FUNCTIONS)})\b", text, re.IGNORECASE):
        reason = K.STATEMENT_FORBIDDEN
    if reason is not None:
        return failed(reason)
    if not re.search(r"\blimit\s+\d+\s*$", text, re.IGNORECASE):
        text = f"{text}\nLIMIT {max_rows}"
    expired = lambda: False
    try:
        runnable = _spark_text(text)
        known = {t.name.lower() for t in session.catalog.listTables() if t.isTemporary}
        outside = _names_outside(session, runnable, known)
        if outside is not None:
            return failed(f"'{outside}' is not allowed; only {K.VIEW_SCHEMA}.* views (or CTEs) may be queried")
        answer = session.sql(runnable).limit(max_rows)
        with time_limit(session, seconds) as expired:
            found = answer.collect()
        return session.createDataFrame(found, answer.schema)
    except (PySparkException, Py4JJavaError) as error:
        if expired():
            return failed(f"the statement took more than {seconds:g} seconds")
        return failed(str(error).strip().split("\n\tat ")[0])
