"""Panel operators: DataFrame -> DataFrame. Unless said otherwise a panel has ts_id, time_d and daily_* columns."""
