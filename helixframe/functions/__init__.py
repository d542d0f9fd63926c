"""Column expressions and the fixed tables behind them."""
