"""CRM sources as Spark data sources: a generated one, and a paged REST reader that pushes filters to the server."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition

SCHEMAS = {
    "contacts": "external_id string, name string, email string, phone string, company string",
    "deals": "external_id string, name string, value double, stage string, close_date string, contact_id string",
    "activities": "external_id string, type string, description string, date string, contact_id string",
}
COUNTS = {"contacts": 20, "deals": 30, "activities": 50}


def generated(entity: str, seed: int = 42) -> Iterator[tuple]:
    """The rows of the built-in demonstration source; the same for the same seed."""
    r = random.Random(f"{seed}-{entity}")
    for i in range(COUNTS[entity]):
        contact = f"contact-{r.randrange(COUNTS['contacts']) + 1}"
        day = f"2024-{r.randrange(12) + 1:02d}-{r.randrange(28) + 1:02d}"
        if entity == "contacts":
            yield f"contact-{i + 1}", f"Contact {i + 1}", f"contact{i + 1}@example.com", f"+1-555-{i + 1:04d}", f"Company {r.randrange(8) + 1}"
        elif entity == "deals":
            stage = r.choice(["lead", "qualified", "proposal", "negotiation", "closed_won", "closed_lost"])
            yield f"deal-{i + 1}", f"Deal {i + 1}", round(r.uniform(1e3, 2e5), 2), stage, day, contact
        else:
            yield f"activity-{i + 1}", r.choice(["call", "email", "meeting"]), f"Activity {i + 1}", day, contact


class CrmDataSource(DataSource):
    """``spark.read.format("crm").option("entity", "deals")``; with ``url`` a REST service, else generated rows.

    The REST reader pushes filters, so the session needs ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "crm"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "contacts")]

    def reader(self, schema) -> DataSourceReader:
        return RestReader(self.options) if self.options.get("url") else GeneratedReader(self.options)


class GeneratedReader(DataSourceReader):
    def __init__(self, options):
        self.entity, self.seed = options.get("entity", "contacts"), int(options.get("seed", "42"))

    def read(self, partition) -> Iterator[tuple]:
        yield from generated(self.entity, self.seed)


class RestReader(DataSourceReader):
    """Pages of ``page_size`` rows; ``stage`` and ``contact_id`` equality and ``value`` minimum become query parameters.

    With ``total``, the service's number of rows, each page of it is a partition of its own; the last one, or the
    only one without ``total``, goes on until a page comes empty, so no row is lost if the number is too small.
    """

    def __init__(self, options):
        self.url, self.entity = options["url"].rstrip("/"), options.get("entity", "contacts")
        self.total, self.size = int(options.get("total", "0")), int(options.get("page_size", "200"))
        self.params: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("stage",), ("contact_id",)):
                self.params[f.attribute[0]] = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("value",):
                self.params["min_value"] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        starts = range(0, max(self.total, 1), self.size)
        return [InputPartition((o, o == starts[-1])) for o in starts]

    def read(self, partition) -> Iterator[tuple]:
        names = [c.split()[0] for c in SCHEMAS[self.entity].split(", ")]
        offset, last = partition.value
        while True:
            query = urlencode({**self.params, "offset": offset, "limit": self.size})
            with urlopen(f"{self.url}/{self.entity}?{query}", timeout=30) as r:  # noqa: S310
                rows = json.load(r)
            for row in rows:
                yield tuple(row.get(n) for n in names)
            if not last or not rows:
                return
            offset += len(rows)
