"""The closed set of analytic operations by name."""

from __future__ import annotations

from tallyhouse.operators import baskets, menu, orders, products
from tallyhouse.plans.forecast import forecast

OPERATIONS = {
    "overview": orders.overview,
    "revenue_over_time": orders.revenue_series,
    "day_of_week": orders.day_of_week,
    "peak_hours": orders.peak_hours,
    "channel_mix": orders.channel_mix,
    "product_performance": products.product_performance,
    "product_movers": products.product_movers,
    "product_trend": products.product_trend,
    "product_attachments": baskets.product_attachments,
    "basket_pairs": baskets.basket_pairs,
    "menu_evidence": menu.menu_evidence,
    "forecast": forecast,
}
