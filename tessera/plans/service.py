"""What a service in front of the engine calls: parse, recommend, take feedback, tell its health."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from tessera.plans.parser import parse, tags
from tessera.plans.recommend import Recommender, check_request, serve
from tessera.schema import FEEDBACK
from tessera.sources.tables import exists
from tessera.streaming.feedback import boosts, token_counts


class Service:
    """``active`` gives the recommender in use and its model's name; it is asked again at every call, so that a swapped model
    serves from the next call on.  ``events`` is the folder to which feedback is added."""

    def __init__(self, active: Callable[[], tuple[Recommender, str]], events: str):
        self.active, self.events = active, events
        self.spark = active()[0].index.sparkSession

    def _feedback(self) -> DataFrame:
        return self.spark.read.schema(FEEDBACK).parquet(self.events) if exists(self.spark, self.events) else self.spark.createDataFrame([], FEEDBACK)

    def health(self) -> dict:
        return {"ok": True, "model": self.active()[1], "feedback": self._feedback().count()}

    def parse(self, text: str) -> list[dict]:
        """The tags of a query."""
        check_request(query=text)
        return tags(parse(text))

    def feedback(self, query: str, keyword: str, liked: bool, menu: str = "", place_id: str = "", chosen: bool = False) -> None:
        """Add one event; what was chosen is liked."""
        query = query.strip()
        check_request(query=query, keyword=keyword, menu=menu, place_id=place_id)
        at = datetime.now(timezone.utc)
        row = (int(at.timestamp() * 1e6), at, query, keyword, menu, place_id, int(liked or chosen), int(chosen))
        self.spark.createDataFrame([row], FEEDBACK).coalesce(1).write.mode("append").parquet(self.events)

    def recommend(self, text: str, limit: int = 5) -> list[dict]:
        """The best menus after the feedback bonus; the bonus of all keywords found is worked out in one query."""
        recommender, _ = self.active()
        events = self._feedback()

        def bonus(keywords: list[str]) -> dict[str, float]:
            pairs = self.spark.createDataFrame([(text, k) for k in keywords], "query string, keyword string")
            return {r["keyword"]: r["boost"] for r in boosts(pairs, token_counts(events)).collect()}

        return serve(recommender, text, limit, bonus)
