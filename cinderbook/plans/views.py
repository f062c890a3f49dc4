"""The standing views, for users who write SQL."""

from __future__ import annotations

import datetime as dt

from cinderbook.plans.buildings import building_performance
from cinderbook.plans.overview import campus_overview
from cinderbook.plans.transport import user_footprint
from cinderbook.schemas import Ledger


def create_views(ledger: Ledger, as_of: dt.date | str) -> None:
    """Register the views `campus_overview`, `building_performance` and `user_footprint`."""
    campus_overview(ledger, as_of).createOrReplaceTempView("campus_overview")
    building_performance(ledger.buildings, ledger.energy).createOrReplaceTempView("building_performance")
    user_footprint(ledger.users, ledger.trips).createOrReplaceTempView("user_footprint")
