"""Plan builders over panels: lags, differences, scaling, sufficient statistics, metrics."""
