"""affinity: user-item preferences from shop data, as Spark DataFrame jobs.

Two preference models:

* purchase preferences (``operators.purchase``): per user and item, the share of
  the user's orders that contain the item, log-scaled and normalised against the
  strongest preference any user has for that item, as an integer 0..5;
* engagement ratings (``operators.engagement``): per user and item, positive
  events net of their reversals, scored from an event score table; the best
  scored event wins and carries its time.

Engagement ratings can be turned into dense user and item indexes and a sparse
feature matrix for context-aware factorization models (``operators.features``).
"""

__all__ = ["schemas"]
