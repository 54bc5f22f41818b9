"""carepulse: a Spark-native pipeline for annual provider utilisation and payment data.

bronze (raw text) -> silver (typed, cleaned) -> gold (provider-year metrics,
state-year summary) -> read-side operators (filtered scans, KPIs, top-N,
distribution summaries), all as DataFrame plans.
"""

__version__ = "0.1.0"
