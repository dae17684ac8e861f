"""Training-data operators: packing, search, token counts, classifiers, decontamination,
similarity joins, substring removal, web archives and license scans.

Nothing outside this package imports it. Query keys are in ``queries``; each operator module
holds a general interface and the query derives its digest columns from it.
"""
