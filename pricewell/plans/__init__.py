"""Named queries: each module registers its own in ``pricewell.registry``."""

from pricewell.plans import catalogue_plans, dashboard_plans, flow_plans, flyer_plans, offer_plans, price_plans, rule_plans, series_plans, store_plans, stream_plans, text_plans  # noqa: F401
