"""Reading source trees and adapting tables to them."""
