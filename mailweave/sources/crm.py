"""Mails of a CRM by case or opportunity.

`from_tables` works on exported tables; `CrmSource` is a Spark data source over any client with a `query` method, whose
filter on the parent is pushed down as a bound parameter. Credentials come as options, never from code.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter

from mailweave.sources.schemas import CRM_MESSAGE


def from_tables(messages: DataFrame, parents: DataFrame, name: str, by: str = "case") -> DataFrame:
    """Messages of the first parent with this case number or opportunity name, in order of date.

    An unknown name gives no rows. The text body is used, the HTML body where there is none.
    """
    key, column = ("parent_id", "case_number") if by == "case" else ("related_to_id", "name")
    first = parents.where(F.col(column) == name).orderBy("id").limit(1).select(F.col("id").alias(key))
    x = messages.join(F.broadcast(first), key, "left_semi")  # one row
    body = F.when(F.length("text_body") > 0, F.col("text_body")).otherwise(F.coalesce("html_body", F.lit("")))
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != "")
    return x.select(
        F.col("id").alias("message_id"), F.col("from_name").alias("sender_name"), F.col("from_address").alias("sender_address"), split("to_address").alias("recipients"), split("cc_address").alias("cc"), F.col("message_date").alias("date"),
        F.coalesce(F.date_format("message_date", "MMM dd"), F.lit("")).alias("date_str"), "subject", body.alias("body"), F.concat(F.lit("SF-Case-" if by == "case" else "SF-Opp-"), F.lit(name)).alias("source_file"),
    ).orderBy("date")


class CrmReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.parent = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("parent_id",):
                self.parent = f.value
            else:
                yield f

    def read(self, partition: object) -> Iterator[tuple]:
        module, _, maker = self.options["client"].rpartition(".")
        client = getattr(importlib.import_module(module), maker)(self.options)
        for r in client.query("EmailMessage", {"parent_id": self.parent} if self.parent else {}):
            yield tuple(r.get(c.split(" ")[0]) for c in CRM_MESSAGE.split(", "))


class CrmSource(DataSource):
    """spark.dataSource.register(CrmSource); spark.read.format("crm").option("client", "module.maker")."""

    @classmethod
    def name(cls) -> str:
        return "crm"

    def schema(self) -> str:
        return CRM_MESSAGE

    def reader(self, schema: object) -> CrmReader:
        return CrmReader(dict(self.options))


def connect(config: dict) -> object | None:
    """A client from the configuration's `crm` entry: `client` names a maker as module.function, which gets the entry; without one
    the optional library simple_salesforce is used. None, with a message, if the library, the credentials or the service are missing.
    """
    given = config.get("crm") or config.get("salesforce") or {}
    if not given.get("username") or not given.get("password"):
        print("no credentials for the CRM; its mails are left out")
        return None
    try:
        if given.get("client"):
            module, _, maker = given["client"].rpartition(".")
            return getattr(importlib.import_module(module), maker)(given)
        import simple_salesforce

        return simple_salesforce.Salesforce(username=given["username"], password=given["password"], security_token=given.get("security_token", ""), domain=given.get("domain", "login"))
    except Exception as e:  # noqa: BLE001
        print(f"no connection to the CRM ({type(e).__name__}: {e}); its mails are left out")
        return None


def read_crm(spark: SparkSession, client: object, name: str, by: str = "case") -> DataFrame:
    """Mails of a case number or opportunity name through a client with query(object, conditions) -> rows as dicts."""
    column, table = ("case_number", "Case") if by == "case" else ("name", "Opportunity")
    parents = [(r["id"], r[column]) for r in client.query(table, {column: name})]
    key = "parent_id" if by == "case" else "related_to_id"
    fields = [f.split(" ")[0] for f in CRM_MESSAGE.split(", ")]
    rows = [tuple(r.get(f) for f in fields) for p, _ in parents[:1] for r in client.query("EmailMessage", {key: p})]
    return from_tables(spark.createDataFrame(rows, CRM_MESSAGE), spark.createDataFrame(parents, f"id string, {column} string"), name, by)
