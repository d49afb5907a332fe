"""tripfold: group-itinerary evaluation as PySpark jobs.

Everything here is a ``DataFrame -> DataFrame`` function or a ``Column`` helper;
Catalyst picks the physical plan.
"""
