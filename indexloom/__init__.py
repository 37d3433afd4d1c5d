"""Spark-native engine for index-construction research.

Domain order: ``sources`` -> ``operators`` (construction, simulation,
analytics) -> ``plans`` (recipes, scenarios, reports); ``functions`` holds the
column expressions they share and ``streaming`` the incremental forms.
"""
