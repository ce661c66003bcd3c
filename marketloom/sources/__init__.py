"""Reading and writing: typed tables, candle files, generated candles, sinks and the catalog."""
