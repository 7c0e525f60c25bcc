"""Operators over packets, flow verdicts, scores and labels: functions of DataFrames or Columns."""
