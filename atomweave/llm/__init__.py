"""Operators of a training-data pipeline over text collections.

Common rules. An operator reads only the columns it names, so further columns, whatever their names, neither disturb
it nor leak into its working tables. A null text counts as an empty one unless the operator says otherwise. Empty
tables give empty results.
"""
